"""Keyed cache tables: latest entry, as-of validity, tiers, pending work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dinesight.operators.common import carry_forward, keep_first

DAY_S = 86_400
NEGATIVE_TTL_S, POSITIVE_TTL_S, MODEL_TTL_S = DAY_S, 7 * DAY_S, 14 * DAY_S


def upsert_latest(base: DataFrame, updates: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Last write per key wins; an update beats the base at the same time."""
    both = base.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    return keep_first(both, keys, [F.desc(ts), F.desc("_new")]).drop("_new")


def latest_valid_cache(requests: DataFrame, cache: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Newest entry at or before each request, if still within its TTL.

    ``requests`` holds the keys, request_id, at; ``cache`` the keys, entry_id,
    at, is_negative. An as-of join without pairing a key's requests and entries.
    """
    entry = F.struct(F.col("at").alias("at"), "entry_id", "is_negative")
    rows = requests.select(*keys, "at", "request_id", F.lit(None).cast("struct<at:timestamp,entry_id:bigint,is_negative:boolean>").alias("entry")) \
        .unionByName(cache.select(*keys, "at", F.lit(None).cast("bigint").alias("request_id"), entry.alias("entry")))
    # At one instant, entries (no request_id) come before requests.
    rows = rows.withColumn("_eid", F.col("entry.entry_id"))
    carried = carry_forward(rows, keys, "at", ["at", "request_id", "_eid"], F.col("entry"), "hit").where("request_id IS NOT NULL")
    age = (F.unix_micros("at") - F.unix_micros("hit.at")) / 1e6
    ttl = F.when(F.col("hit.is_negative"), NEGATIVE_TTL_S).otherwise(POSITIVE_TTL_S)
    return carried.select(*keys, "request_id", "at", F.when(age <= ttl, F.col("hit.entry_id")).alias("entry_id"))


def two_tier_lookup(requests: DataFrame, primary: DataFrame, fallback: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Primary payload, else fallback, with its origin."""
    joined = requests.join(primary.withColumnRenamed("payload", "_p"), list(keys), "left").join(
        fallback.withColumnRenamed("payload", "_f"), list(keys), "left")
    origin = F.when(F.col("_p").isNotNull(), "db").when(F.col("_f").isNotNull(), "disk")
    return joined.withColumn("payload", F.coalesce("_p", "_f")).withColumn("origin", origin).drop("_p", "_f")


def pending(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work not recorded as done."""
    return work.join(done.select(*keys).distinct(), list(keys), "left_anti")


def attempts_in_window(log: DataFrame, client: str, ts: str, window_s: int = 60) -> DataFrame:
    """Requests of each client in (t - window, t], for every request.

    Each event counts in its own time slice and the next one, so a client's
    log is spread over slices instead of one partition.
    """
    micros = F.unix_micros(ts)
    width = window_s * 1_000_000
    counted = log.groupBy(client, micros.alias("_t")).agg(F.count("*").alias("_n"))
    own = F.floor(F.col("_t") / width)
    copies = counted.select(client, "_t", "_n", F.explode(F.array(
        F.struct(own.alias("slice"), F.lit(True).alias("own")), F.struct((own + 1).alias("slice"), F.lit(False).alias("own")))).alias("_s"))
    trailing = Window.partitionBy(client, "_s.slice").orderBy("_t").rangeBetween(-(width - 1), 0)
    attempts = copies.withColumn("attempts", F.sum("_n").over(trailing)).where("_s.own").select(client, "_t", "attempts")
    return log.withColumn("_t", micros).join(attempts, [client, "_t"]).drop("_t")


def daily_cap(log: DataFrame, ts: str, cap: int) -> DataFrame:
    """Requests per UTC day and whether they exceed the cap."""
    return log.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n_requests")).withColumn(
        "over_cap", (F.lit(cap) > 0) & (F.col("n_requests") > cap))
