"""Shared relational building blocks, written to survive hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int | None = 1, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of every key, all of them without ``n``.

    The rank filter sits directly on the window, so Spark prunes each map task
    to ``n`` rows per key before the shuffle: a key holding a third of the
    table never travels whole to one task.
    """
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    ranked = ranked if n is None else ranked.where(F.col(name) <= n)
    return ranked if rank else ranked.drop(name)


def spread(scan: DataFrame) -> DataFrame:
    """Deal out a scan that came as fewer pieces than there are cores.

    For CPU-heavy row work on small inputs (one file, one row group). A large
    table already scans as more pieces than cores and is returned unchanged, so
    no shuffle is added at scale.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def grown(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the data: joined by shuffles, never sent whole to the driver.

    The planner guesses sizes from compressed files; users, restaurants and their lists can be many times that.
    """
    return side.hint("merge")


def bounded_rows(df: DataFrame, max_rows: int) -> list[dict] | None:
    """The rows of a small dimension, or None when it is larger than the bound."""
    rows = df.limit(max_rows + 1).collect()
    return [r.asDict(recursive=True) for r in rows] if len(rows) <= max_rows else None


def union_terms(df: DataFrame, keys: Sequence[str], arrays: Sequence[str]) -> DataFrame:
    """Per key, the sorted union of each array column.

    Terms are exploded and collected as sets, which combine map-side: a buffer
    is bounded by the distinct terms of a key, not by its number of rows.
    """
    empty = F.expr("CAST(array() AS ARRAY<STRING>)")

    def tagged(name: str) -> Column:
        return F.transform(F.coalesce(F.col(name), empty), lambda t: F.struct(F.lit(name).alias("kind"), t.alias("term")))

    long = df.select(*keys, F.explode(F.concat(*[tagged(a) for a in arrays])).alias("_t"))
    return long.groupBy(*keys).agg(*[
        F.array_sort(F.collect_set(F.when(F.col("_t.kind") == a, F.col("_t.term")))).alias(a) for a in arrays])


def merge_records(df: DataFrame, keys: Sequence[str], order: Sequence[Column], arrays: Sequence[str]) -> DataFrame:
    """One row per key: identity of the best row, union of everyone's arrays."""
    empty = F.expr("CAST(array() AS ARRAY<STRING>)")
    winners = keep_first(df, keys, order).drop(*arrays)
    terms = union_terms(df, keys, arrays)
    joined = winners.join(terms, list(keys), "left")
    return joined.select(*[c for c in winners.columns],
                         *[F.coalesce(F.col(a), empty).alias(a) for a in arrays])


def prefix_budget(df: DataFrame, keys: Sequence[str], order: Sequence[Column], amount: Column, budget: int,
                  salts: int = 16) -> DataFrame:
    """Rows of every key while the running total before them is under a budget.

    Two rounds: within salted slices first, then over the survivors. A row cut
    in its slice has at least ``budget`` ahead of it overall too, so the result
    is exact while a hot key is spread over ``salts`` tasks.
    """
    tie = F.hash(*df.columns)
    sized = df.withColumn("_amount", amount).withColumn("_salt", F.pmod(tie, F.lit(salts)))

    def before(*partition: str) -> Column:
        window = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("_amount").over(window), F.lit(0))

    first = sized.withColumn("_before", before(*keys, "_salt")).where(F.col("_before") < budget)
    return (first.drop("_salt").withColumn("_before", before(*keys)).where(F.col("_before") < budget)
            .withColumn("budget_before", F.col("_before")).drop("_before", "_amount"))


def global_rank_bounds(df: DataFrame, value: str, buckets: int = 64) -> DataFrame:
    """Per distinct value: rows below it (``below``) and rows equal (``peers``).

    No global window: values are cut into ranges at approximate quantiles (a
    fixed, small number of split points), each range is ranked in its own
    partition, and range totals are added as offsets.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("peers"))
    shares = [i / buckets for i in range(1, buckets)]
    cuts = counts.agg(F.percentile_approx(value, shares, 1000).alias("c")).first()["c"] or []
    literal = F.array(*[F.lit(c) for c in sorted(set(cuts))]) if cuts else F.expr("CAST(array() AS ARRAY<DOUBLE>)")
    ranged = counts.withColumn("_range", F.size(F.filter(literal, lambda c: c < F.col(value))))
    totals = ranged.groupBy("_range").agg(F.sum("peers").alias("_total"))
    offsets = totals.withColumn("_offset", F.coalesce(F.sum("_total").over(
        Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    window = Window.partitionBy("_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.withColumn("_inside", F.coalesce(F.sum("peers").over(window), F.lit(0)))
    # At most ``buckets`` rows on the broadcast side.
    return (inside.join(F.broadcast(offsets.select("_range", "_offset")), "_range")
            .select(value, (F.col("_offset") + F.col("_inside")).alias("below"), "peers"))


def numbered(df: DataFrame, keys: Sequence[str], ordinal: str, name: str, width: int = 100_000) -> DataFrame:
    """1, 2, 3, ... per key in the order of a unique integer column.

    Numbered inside slices of ``width`` ordinals, plus the rows of the slices
    before: a key of any size is spread over as many tasks as it has slices.
    """
    sliced = df.withColumn("_slice", F.floor(F.col(ordinal) / width))
    counts = sliced.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(ordinal))
    return (sliced.withColumn("_inside", inside).join(offsets, [*keys, "_slice"])
            .withColumn(name, F.col("_before") + F.col("_inside")).drop("_slice", "_inside", "_before"))


def carry_forward(df: DataFrame, keys: Sequence[str], time: str, order: Sequence[str], value: Column, name: str,
                  width_s: int = 3600) -> DataFrame:
    """Latest non-null ``value`` at or before each row of its key.

    ``order`` names ascending columns, nulls first, starting with ``time``.
    Rows are windowed inside time slices; what a slice inherits is the latest
    value of earlier slices, found over one row per key and slice.
    """
    sliced = df.withColumn("_v", value).withColumn("_slice", F.floor(F.unix_micros(time) / (width_s * 1_000_000)))
    lasts = sliced.where("_v IS NOT NULL").groupBy(*keys, "_slice").agg(F.max_by("_v", F.struct(*order)).alias("_last"))
    slices = sliced.select(*keys, "_slice").distinct().join(lasts, [*keys, "_slice"], "left")
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    inherited = slices.select(*keys, "_slice", F.last("_last", ignorenulls=True).over(earlier).alias("_inherited"))
    here = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (sliced.withColumn("_own", F.last("_v", ignorenulls=True).over(here)).join(inherited, [*keys, "_slice"])
            .withColumn(name, F.coalesce("_own", "_inherited")).drop("_v", "_slice", "_own", "_inherited"))
