"""Operator 11: hard negatives by exact matrix products in a residue number system.

Vectors become integers. Blocks of anchors meet blocks of rows; in a cell the component
matrices are reduced modulo several small primes and multiplied in float32, where no sum can
round, and Chinese remaindering gives the exact signed scores. The primes are as large as
float32 allows and as many as the largest possible score needs.

A first pass over the cells keeps each anchor's nearest rows of its own label, its positives.
Each positive opens a window of scores; a second pass keeps the best rows of other labels in
each window. Both keep a few rows per anchor (and window) of a cell, merged by a window that
Spark limits before it shuffles. Blocks are cut by a hash of the id, so neither a label nor copies
of a vector that hold a third of the rows make a large group.

Null ids, null labels, null vectors and vectors with a null or a value that is not finite take no part; nor do vectors
whose length is not the most frequent one (of equally frequent the longest). Rows with the same id count as one: the least
by label, then hash of the vector. Ties of score go to the smaller id. An anchor without positives, and a window without
negatives, give no rows; so does an empty table. Scores that could leave the range of long (entries beyond
about 2**28 after scaling) raise an error before any work. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import isqrt, prod

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dinesight.llm.common import small_batches, stored

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between these hundredths of the positive's.
LOWEST, HIGHEST = 50, 95
#: Components multiplied at a time: their products sum under 2**24, so that float32 is exact.
SEGMENT = 64
#: Scores held at a time, anchors of a cell, and components of its rows.
SCORES, ANCHOR_BLOCK, ROW_VALUES = 1 << 20, 2_048, 1 << 20
#: Entries that are integers in float64 and whose residues are exact.
LARGEST = float(1 << 52)
FOUND = "anchor_id long, positive long, id long, score long"


def primes_for(bound: int) -> list[int]:
    """The largest primes whose residues multiply exactly in float32, as many as scores up to ``bound`` (either sign) need."""
    top = 2 * isqrt(((1 << 24) - 1) // SEGMENT) + 1
    primes: list[int] = []
    p = top
    while prod(primes) <= 2 * bound:
        if all(p % q for q in range(2, isqrt(p) + 1)):
            primes.append(p)
        p -= 1
    return primes


def residues(x: np.ndarray, p: int) -> np.ndarray:
    """Integers (as doubles) modulo ``p``, of least absolute value, as float32."""
    r = np.fmod(x, p)
    return (r - p * np.rint(r / p)).astype(np.float32)


class ResidueMatrix:
    """A matrix of integers, once per prime."""

    def __init__(self, x: np.ndarray, primes: list[int]):
        self.primes = primes
        self.parts = [residues(x, p) for p in primes]

    def times(self, other: ResidueMatrix, rows: slice, columns: slice) -> np.ndarray:
        """``self[rows] @ other[columns].T`` as exact int64: float32 products per prime, then mixed radix with signed digits."""
        value, radix = np.int64(0), 1
        for p, a, b in zip(self.primes, self.parts, other.parts, strict=True):
            r = np.zeros((len(a[rows]), len(b[columns])), np.int64)
            for k in range(0, a.shape[1], SEGMENT):
                r += (a[rows, k:k + SEGMENT] @ b[columns, k:k + SEGMENT].T).astype(np.int64)
            digit = (r - value) % p * pow(radix, -1, p) % p
            # Digits of either sign stand for every number up to half the product of the primes.
            value = value + radix * np.where(digit > p // 2, digit - p, digit)
            radix *= p
        return value


def usable(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``id, label, v``: one row per id that takes part; ``v`` are integers as doubles."""
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * float(scale))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull())
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), v.alias("v"))
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    rows = rows.where(F.size("v") == (lengths["d"] if lengths else -1))
    first = rows.groupBy("id").agg(F.min_by(F.struct("label", "v"), F.struct("label", F.xxhash64("v"))).alias("r"))
    return first.select("id", "r.label", F.transform("r.v", lambda x: F.when(F.abs(x) < LARGEST, F.floor(x).cast("double")).otherwise(x)).alias("v"))


def _best(order: np.ndarray, scores: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Of the positions ``order``, those of the ``most`` highest scores, ties to the smaller id."""
    if len(order) > most:
        cut = np.partition(scores[order], len(order) - most)[len(order) - most]
        order = order[scores[order] >= cut]
    return order[np.lexsort((ids[order], -scores[order]))[:most]]


def _cells(left: DataFrame, right: DataFrame, width: int, pick: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """``pick(rows, anchors)`` for every block of ``left`` (rows) against every block of ``right`` (anchors)."""
    n_rows, n_anchors = left.count(), right.count()
    cut = {"a": max(1, -(-n_rows // max(256, ROW_VALUES // width))), "b": max(1, -(-n_anchors // ANCHOR_BLOCK))}

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        return df.select("*", F.pmod(F.xxhash64("id"), F.lit(cut[own])).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(cut[other] - 1))).alias(other))

    def cell(rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(anchors):
            return pd.DataFrame({name.split()[0]: pd.Series([], dtype="int64") for name in FOUND.split(", ")})
        return pick(rows, anchors)
    return dealt(left, "a", "b").groupBy("a", "b").cogroup(dealt(right, "b", "a").groupBy("a", "b")).applyInPandas(cell, FOUND)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 1))


def _frame(parts: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pd.DataFrame:
    sizes = [len(ids) for _, _, ids, _ in parts]
    return pd.DataFrame({"anchor_id": np.repeat([a for a, _, _, _ in parts], sizes).astype(np.int64), "positive": np.repeat([p for _, p, _, _ in parts], sizes).astype(np.int64),
                         "id": np.concatenate([ids for _, _, ids, _ in parts] or [[]]).astype(np.int64), "score": np.concatenate([s for _, _, _, s in parts] or [[]]).astype(np.int64)})


def _scored(rows: pd.DataFrame, anchors: pd.DataFrame, primes: list[int]) -> Iterator[tuple[np.ndarray, slice]]:
    """Exact scores of runs of anchors (the slice) against all rows of the cell; a run holds about ``SCORES`` of them."""
    r, a = ResidueMatrix(_matrix(rows["v"]), primes), ResidueMatrix(_matrix(anchors["v"]), primes)
    step = max(1, SCORES // max(len(rows), 1))
    for k in range(0, len(anchors), step):
        part = slice(k, min(k + step, len(anchors)))
        yield a.times(r, part, slice(None)), part


def _nearest_of_label(primes: list[int], most: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def pick(rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out = []
        # Only rows and anchors of one label are multiplied.
        by_label = dict(tuple(rows.groupby("label")))
        for label, asking in anchors.groupby("label"):
            mine = by_label.get(label)
            if mine is None:
                continue
            ids = mine["id"].to_numpy()
            for scores, part in _scored(mine, asking, primes):
                for score, anchor in zip(scores, asking["id"].to_numpy()[part].tolist(), strict=True):
                    best = _best(np.flatnonzero(ids != anchor), score, ids, most)
                    out.append((anchor, 0, ids[best], score[best]))
        return _frame(out)
    return pick


def _hardest_in_windows(primes: list[int], most: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def pick(rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out = []
        ids, labels = rows["id"].to_numpy(), rows["label"].to_numpy()
        for scores, part in _scored(rows, anchors, primes):
            some = anchors.iloc[part]
            for score, anchor, label, windows in zip(scores, some["id"].tolist(), some["label"].tolist(), some["windows"], strict=True):
                for window in windows:
                    inside = np.flatnonzero((labels != label) & (score >= window["low"]) & (score <= window["high"]))
                    best = _best(inside, score, ids, most)
                    out.append((anchor, window["positive"], ids[best], score[best]))
        return _frame(out)
    return pick


def _ranked(found: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "positive").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, scale: int = SCALE,
                   lowest: int = LOWEST, highest: int = HIGHEST) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of ``vectors (vec_id, embedding, label)``.

    ``anchors`` is a condition on ``id``. A negative has another label and ``lowest * positive_score <= 100 * negative_score <=
    highest * positive_score``; of each anchor and positive the best ``negatives`` are returned.
    """
    small_batches(vectors.sparkSession)
    base = stored(usable(vectors, scale))
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    # No inner product exceeds the largest sum of squares; a little is added for its rounding.
    largest, width = base.agg(F.coalesce(F.max(squares), F.lit(0.0)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    if largest * 100 >= 1 << 62:
        raise ValueError("hard_negatives: scores would leave the range of long")
    primes, width = primes_for(int(largest * (1 + 1e-9)) + 1), max(width, 1)
    asked = stored(base.where(anchors))
    near = stored(_ranked(_cells(base, asked, width, _nearest_of_label(primes, positives)), positives))
    # Whole numbers between low and high: 100 * score within the two products, rounded up and down.
    window = F.struct(F.col("id").alias("positive"), F.ceil(F.col("score") * lowest / F.lit(100).cast("decimal(3,0)")).cast("long").alias("low"),
                      F.floor(F.col("score") * highest / F.lit(100).cast("decimal(3,0)")).cast("long").alias("high"))
    windows = near.groupBy(F.col("anchor_id").alias("id")).agg(F.array_sort(F.collect_list(window)).alias("windows"))
    opened = stored(asked.join(windows, "id"))
    found = _ranked(_cells(base, opened, width, _hardest_in_windows(primes, negatives)), negatives)
    scores = near.select("anchor_id", F.col("id").alias("positive"), F.col("score").alias("positive_score"))
    return found.join(scores, ["anchor_id", "positive"]).select(
        "anchor_id", F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
