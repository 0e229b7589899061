"""A corpus from raw documents to token ids: rules, near duplicates, repeated strings, mixing, encoding.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept; its result is written as Parquet and
read again. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dinesight.llm.common import read_table, small_batches, stored
from dinesight.llm.mixing import mixed_documents
from dinesight.llm.ngram_join import keep_one_per_class
from dinesight.llm.quality_rules import keep_good
from dinesight.llm.sentencepiece import encoded
from dinesight.llm.suffix_dedup import without_repeats


#: Fifty words with a space each take more; a passage has to be caught wherever it begins and ends.
REPEATED_BYTES = 200


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity 0.8 or more."""
    return keep_one_per_class(docs, size=5, percent=80)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated strings are cut from the texts, from the length of a passage of some 50 short words on."""
    return without_repeats(docs, REPEATED_BYTES)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target takes it."""
    return mixed_documents(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text."""
    small_batches(spark)
    return encoded(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules), ("ngram_join", ngram_join), ("suffix_dedup", suffix_dedup), ("mixing", mixing), ("sentencepiece", sentencepiece)]

#: The likelihood ratio of the first stage has no SQL; tests compare each stage with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
