"""Registered queries: each binds one or more operators to the given tables.

An entry pairs a Spark callable ``(spark, sf_dir) -> DataFrame`` with the SQL
that must return the same rows; entries without SQL are checked by unit tests.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Runner = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    covers: tuple[str, ...]
    run: Runner
    sql: str | None


ENTRIES: dict[str, Entry] = {}
_MODULES = ["text_queries", "source_queries", "place_queries", "tagging_queries", "evidence_queries", "page_queries", "scoring_queries",
            "report_queries", "evaluation_queries", "stream_queries"]


def query(name: str, covers: str, sql: str | None = None) -> Callable[[Runner], Runner]:
    """Register a query under ``name``; ``covers`` lists inventory ids."""
    def register(run: Runner) -> Runner:
        if name in ENTRIES:
            raise ValueError(f"query {name!r} registered twice")
        ENTRIES[name] = Entry(name, tuple(covers.split()), run, sql)
        return run
    return register


def load() -> dict[str, Entry]:
    """All registered entries."""
    for module in _MODULES:
        importlib.import_module(f"dinesight.catalog.{module}")
    return ENTRIES
