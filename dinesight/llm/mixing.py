"""Operator 3: mixing sources to target weights by capped water-filling.

A document's size is its number of words. Sources, ordered by code point with
null last, weigh 3, 1, 2, repeating; together they get 150 % of all words. No
source gets more than 2 times its words: excess goes to the others by weight
until no target is above its cap. A source's target becomes whole repetitions of
all its documents and, for the rest, one more repetition of the documents that
come first in a seeded order.

Sources are rows of a table, numbered by ranges; the level of the water is found
by sums over it. The seeded order is cut into 4,096 slices a source: slices are
summed first, and only the one that holds the cut is ordered, so a source with a
third of all rows is spread. Everything is DataFrame functions.

Null and empty texts have size 0 and take 0. Equal rows are documents of their
own. A table without words has target 0 everywhere. Only ``doc_id``, ``text``
and ``source`` are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dinesight.llm.common import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"
_SLICE_DIGITS = 3


def source_targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, epochs: int = MAX_EPOCHS) -> DataFrame:
    """``s, source_size, target`` for a table of sources ``(s, source_size)`` in the order of ``s``."""
    ranged = sources.repartitionByRange("s").withColumn("_p", F.spark_partition_id())
    ranged = stored(ranged.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy("s"))))
    # One row per range.
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_before") + F.col("_i") - 1, F.lit(len(weights))) + 1).cast("int"))
    table = stored(ranged.join(before, "_p").select("s", "source_size", weight.alias("w"), (epochs * F.col("source_size")).cast("double").alias("cap")))
    words, total_weight = table.agg(F.sum("source_size"), F.sum("w")).first()
    budget = share * (words or 0)
    level, last = (budget / total_weight if total_weight else 0.0), None
    while level != last:
        full = F.col("cap") < F.lit(level) * F.col("w")
        capped, open_weight = table.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("w")))).first()
        last, level = level, ((budget - (capped or 0.0)) / open_weight if open_weight else level)
    return table.select("s", "source_size", F.least("cap", F.lit(level) * F.col("w")).alias("target"))


def _keyed(docs: DataFrame, seed: str) -> DataFrame:
    """Adds ``s`` (the source, null after all others), ``size``, ``order`` and ``slice``."""
    return (docs.withColumn("_s", F.coalesce(F.concat(F.lit("a"), F.col("source")), F.lit("b")))
            .withColumn("_size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
            .withColumn("_order", F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")).cast("binary")))
            .withColumn("_slice", F.substring("_order", 1, _SLICE_DIGITS)))


def slices(keyed: DataFrame) -> DataFrame:
    """Per source and slice: its words before it (``_before``) and in it, whole repetitions, and words still needed."""
    sums = stored(keyed.groupBy("_s", "_slice").agg(F.sum("_size").alias("_words")))
    targets = source_targets(sums.groupBy(F.col("_s").alias("s")).agg(F.sum("_words").alias("source_size")))
    before = F.coalesce(F.sum("_words").over(Window.partitionBy("_s").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return stored(sums.withColumn("_before", before).join(targets.withColumnRenamed("s", "_s"), "_s")
                  .withColumn("_whole", whole).withColumn("_need", F.col("target") - F.col("_whole") * F.col("source_size")))


def repetitions(keyed: DataFrame) -> DataFrame:
    """``keyed`` rows with source_size, target and ``_times``, how often the mix takes the document."""
    plan = slices(keyed)
    joined = keyed.join(plan, ["_s", "_slice"])
    inside = F.coalesce(F.sum("_size").over(Window.partitionBy("_s", "_slice").orderBy("_order", "doc_id", "_size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    end = F.col("_before") + F.col("_words")
    ahead = F.col("_before") + F.col("_inside")
    extra: Column = F.when(end < F.col("_need"), 1).when(F.col("_before") >= F.col("_need"), 0).when(
        (ahead < F.col("_need")) & (2 * ahead + F.col("_size") <= 2 * F.col("_need")), 1).otherwise(0)
    return joined.withColumn("_inside", inside).withColumn("_times", F.col("_whole") + extra)


def mix_sources(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """Per document: doc_id, size, source_size, target (its source's), taken (words, repeats counted)."""
    keyed = stored(_keyed(docs, seed).select(F.col("doc_id").cast("long").alias("doc_id"), "_s", "_size", "_order", "_slice"))
    return repetitions(keyed).select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("_times")).alias("taken"))


def mixed_documents(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mix itself: every document as often as it is taken, unchanged."""
    # The caller's row travels as one column, whatever its columns are called.
    rows = docs.select("doc_id", "source", "text", F.struct("*").alias("row"))
    times = repetitions(_keyed(rows, seed).drop("source", "text")).where("_times > 0")
    return times.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("row.*")
