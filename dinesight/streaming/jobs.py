"""Streaming jobs; each plan also runs on a static table as its batch twin.

Late rows: watermark of ten minutes, rows behind it are dropped and counted by
the engine's stateful-operator metrics.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from dinesight.operators.caching import NEGATIVE_TTL_S, POSITIVE_TTL_S, attempts_in_window
from dinesight.operators.common import carry_forward, keep_first
from dinesight.session import cut_lineage

WATERMARK = "10 minutes"
REQUEST_LIMIT, AUTH_FAILURE_LIMIT = 30, 15


def client_rate(log: DataFrame, limit: int = REQUEST_LIMIT, window: str = "60 seconds", slide: str = "10 seconds") -> DataFrame:
    """Requests per client in sliding windows, flagged above the limit.

    ``log`` holds client and ts. Counts combine map-side, so a client holding
    much of the log is one partial count per task.
    """
    counted = log.withWatermark("ts", WATERMARK).groupBy(F.window("ts", window, slide), "client").agg(F.count("*").alias("n_requests"))
    return counted.select("client", F.col("window.start").alias("window_start"), "n_requests", (F.col("n_requests") > limit).alias("over_limit"))


def daily_requests(log: DataFrame, cap: int) -> DataFrame:
    """Requests per UTC day against the cap."""
    counted = log.withWatermark("ts", WATERMARK).groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n_requests"))
    return counted.select(F.to_date("window.start").alias("day"), "n_requests", (F.col("n_requests") > cap).alias("over_cap"))


def dedupe(log: DataFrame, keys: list[str]) -> DataFrame:
    """First record of every key within the watermark horizon."""
    return log.withWatermark("ts", WATERMARK).dropDuplicatesWithinWatermark(keys)


def pair_stages(starts: DataFrame, ends: DataFrame, within: str = "15 minutes") -> DataFrame:
    """Starts joined to their completion; a start without one has failed.

    ``starts`` holds run_id, stage, started_at; ``ends`` run_id, stage, done_at.
    """
    left = starts.withWatermark("started_at", WATERMARK).alias("s")
    right = ends.withWatermark("done_at", WATERMARK).alias("d")
    on = ((F.col("s.run_id") == F.col("d.run_id")) & (F.col("s.stage") == F.col("d.stage")) & (F.col("d.done_at") >= F.col("s.started_at"))
          & (F.col("d.done_at") <= F.col("s.started_at") + F.expr(f"INTERVAL {within}")))
    joined = left.join(right, on, "left_outer")
    return joined.select("s.run_id", "s.stage", "s.started_at", "d.done_at", F.when(F.col("d.done_at").isNull(), "failed").otherwise("done").alias("status"))


# --- Exact admission --------------------------------------------------------------
def admission_stream(log: DataFrame, limit: int = REQUEST_LIMIT, window_s: int = 60) -> DataFrame:
    """Admit or reject each request; rejected ones do not count.

    State per client is the timestamps of its admitted requests in the window,
    at most ``limit`` of them; it goes once the watermark has passed the window.
    ``log`` holds client, event_id, ts.
    """
    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        hits = deque(state.get[0] if state.exists else [])
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        admitted = []
        for at in rows["ts"].astype("int64") // 1000:
            while hits and hits[0] <= at - window_s * 1_000_000:
                hits.popleft()
            admitted.append(len(hits) < limit)
            if admitted[-1]:
                hits.append(int(at))
        state.update((list(hits),))
        # In event time: on a replay the state lives as long as the log says, however fast it is read.
        state.setTimeoutTimestamp(max(int(rows["ts"].astype("int64").max()) // 1_000_000 + window_s * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"client": key[0], "event_id": rows["event_id"].to_numpy(), "admitted": admitted})

    return log.select("client", "event_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", WATERMARK).groupBy("client").applyInPandasWithState(
        decide, "client string, event_id bigint, admitted boolean", "hits array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def _admit(batches: Iterator[pd.DataFrame], limit: int, window_us: int) -> Iterator[pd.DataFrame]:
    """Walk sorted rows, keeping the admitted timestamps of the current piece; rows with ``held`` were admitted before.

    While the queue is full no row is looked at until the oldest timestamp leaves the window.
    """
    current, hits = None, deque()
    for rows in batches:
        times, held = rows["t"].to_numpy(), rows["held"].to_numpy()
        admitted = held.copy()
        same = (rows["client"] == rows["client"].shift()) & (rows["piece"] == rows["piece"].shift())
        edges = [*np.flatnonzero(~same.to_numpy()).tolist(), len(rows)]
        for first, stop in zip(edges, edges[1:]):
            key = (rows["client"].iloc[first], rows["piece"].iloc[first])
            if key != current:
                current, hits = key, deque()
            k = first
            while k < stop:
                at = times[k]
                while hits and hits[0] <= at - window_us:
                    hits.popleft()
                if held[k] or len(hits) < limit:
                    admitted[k] = True
                    hits.append(at)
                    k += 1
                else:
                    k += max(1, int(np.searchsorted(times[k:stop], hits[0] + window_us)))
        yield rows[["client", "piece", "event_id", "t", "held"]].assign(admitted=admitted)


def _pieces(counted: DataFrame, limit: int, window_us: int) -> DataFrame:
    """Rows that may meet a full queue, with the piece of the log they belong to: ``client, piece, event_id, t``.

    An attempt with at most ``limit`` attempts in its window is admitted whatever came before. So the queue is known wherever a
    whole window held no fuller one: a piece starts a window before the first full attempt and ends with the last.
    """
    rows = counted.select("client", "event_id", F.unix_micros("ts").alias("t"), "ts", "attempts")
    full = rows.where(F.col("attempts") > limit).select("client", "ts", "t").distinct()
    before = full.select("client", F.timestamp_micros(F.col("t") + 1).alias("ts"), F.col("t").alias("_seen"), F.lit(None).cast("bigint").alias("t"))
    asked = full.select("client", "ts", F.lit(None).cast("bigint").alias("_seen"), "t").unionByName(before)
    # What lies just behind an attempt sorts after it and before the next one.
    last = carry_forward(asked, ["client"], "ts", ["ts", "t"], F.col("_seen"), "_last").where("t IS NOT NULL")
    starts = last.withColumn("_start", F.when(F.col("_last").isNull() | (F.col("t") - F.col("_last") >= window_us), F.col("t")))
    chains = carry_forward(starts, ["client"], "ts", ["ts"], F.col("_start"), "piece")
    pieces = chains.groupBy("client", "piece").agg(F.max("t").alias("end"))
    opening = pieces.select("client", F.timestamp_micros(F.col("piece") - window_us + 1).alias("ts"), F.struct("piece", "end").alias("_p"),
                            F.lit(None).cast("bigint").alias("event_id"), F.lit(None).cast("bigint").alias("t"), F.lit(None).cast("bigint").alias("attempts"))
    every = rows.withColumn("_p", F.lit(None).cast("struct<piece:bigint,end:bigint>")).unionByName(opening)
    held = carry_forward(every, ["client"], "ts", ["ts", "event_id"], F.col("_p"), "_in").where("t IS NOT NULL")
    return held.where(F.col("t") <= F.col("_in.end")).select("client", F.col("_in.piece").alias("piece"), "event_id", "t")


def admissions(log: DataFrame, limit: int = REQUEST_LIMIT, window_s: int = 60, slice_rows: int = 1_000_000) -> DataFrame:
    """Batch twin of admission_stream: ``client, event_id, admitted``.

    Only pieces of a client's log in which the queue can be full are walked, each streaming over sorted rows with a bounded queue. Of
    the attempts of one instant only the first ``limit`` can be admitted. A piece of more than ``slice_rows`` rows is cut in
    slices that hand their queue over: the admitted rows of the last window lead the next slice, so no task holds or
    sorts more than a slice, and a lost one costs that slice.
    """
    window_us = window_s * 1_000_000
    counted = attempts_in_window(log, "client", "ts", window_s)
    near = cut_lineage(keep_first(_pieces(counted, limit, window_us), ["client", "piece", "t"], [F.asc("event_id")], limit))
    sizes = near.groupBy("client", "piece").agg(F.count("*").alias("n"))
    large = cut_lineage(sizes.where(F.col("n") > slice_rows))
    schema = "client string, piece bigint, event_id bigint, t bigint, held boolean, admitted boolean"

    def walk(rows: DataFrame) -> DataFrame:
        ordered = rows.repartition("client", "piece").sortWithinPartitions("client", "piece", "t", F.desc("held"), "event_id")
        return ordered.mapInPandas(partial(_admit, limit=limit, window_us=window_us), schema)

    fresh = near.select(F.col("client").cast("string").alias("client"), "piece", "event_id", "t", F.lit(False).alias("held"))
    big = large.select(F.col("client").cast("string").alias("client"), "piece", "n")
    walked = walk(fresh.join(big, ["client", "piece"], "left_anti"))
    most = big.agg(F.max("n")).first()[0] or 0
    if most:
        # Cuts at approximate quantiles of time, at most one per slice_rows rows.
        parts = -(-most // slice_rows)
        cuts = fresh.join(big, ["client", "piece"]).groupBy("client", "piece").agg(F.percentile_approx("t", [k / parts for k in range(1, parts)], 10_000).alias("cuts"))
        sliced = cut_lineage(fresh.join(cuts, ["client", "piece"]).withColumn("_slice", F.size(F.filter(F.array_distinct("cuts"), lambda c: c < F.col("t")))).drop("cuts"))
        queue = None
        for k in range(parts):
            rows = sliced.where(F.col("_slice") == k).drop("_slice")
            done = cut_lineage(walk(rows if queue is None else rows.unionByName(queue)))
            ends = done.groupBy("client", "piece").agg(F.max("t").alias("_end"))
            queue = done.join(ends, ["client", "piece"]).where(F.col("admitted") & (F.col("t") > F.col("_end") - window_us)).select(
                "client", "piece", "event_id", "t", F.lit(True).alias("held"))
            walked = walked.unionByName(done)
    decided = walked.where("NOT held").select("client", "event_id", "admitted")
    # Full attempts beyond the first ones of their instant were never walked, and all others are admitted.
    all_rows = counted.select(F.col("client").cast("string").alias("client"), "event_id", (F.col("attempts") <= limit).alias("_free"))
    return all_rows.join(decided, ["client", "event_id"], "left").select("client", "event_id", F.coalesce("admitted", "_free").alias("admitted"))


# --- Keyed tables fed by streams -------------------------------------------------------
def append_latest(path: str, keys: list[str], ts: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer: each batch's last write per key, one folder per epoch.

    Replaying an epoch overwrites its own folder, so the sink is exactly-once
    and no batch rewrites the table.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        keep_first(batch, keys, [F.desc(ts)]).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
    return write


def cache_refresh_stream(entries: DataFrame, path: str, checkpoint: str, keys: list[str] | None = None) -> StreamingQuery:
    """Keeps the newest entry per key on storage."""
    writer = append_latest(path, keys or ["namespace", "key"], "at")
    return entries.writeStream.foreachBatch(writer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_cache(spark: SparkSession, path: str, as_of: str, keys: list[str] | None = None) -> DataFrame:
    """Newest entry per key, unless its positive or negative lifetime has passed."""
    latest = keep_first(spark.read.parquet(path), keys or ["namespace", "key"], [F.desc("at"), F.desc("epoch")])
    age = F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds("at")
    return latest.where(age <= F.when(F.col("is_negative"), NEGATIVE_TTL_S).otherwise(POSITIVE_TTL_S))


def compact_cache(spark: SparkSession, path: str, target: str, keys: list[str] | None = None) -> None:
    """Rewrites the delta folders as one table of latest entries."""
    latest = keep_first(spark.read.parquet(path), keys or ["namespace", "key"], [F.desc("at"), F.desc("epoch")])
    latest.drop("epoch").write.mode("overwrite").parquet(f"{target}/epoch=0")


def rescore_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """What turns the rows ``before`` into ``after``: withdrawn rows with ``change`` -1, new ones with 1; rows in both give none.

    Rows are compared whole, nulls equal; a row that stands several times counts as often. Sums combine before they are shuffled.
    """
    columns = before.columns
    both = before.withColumn("change", F.lit(-1)).unionByName(after.select(columns).withColumn("change", F.lit(1)))
    return both.groupBy(*columns).agg(F.sum("change").alias("change")).where("change <> 0")


def applied(deltas: DataFrame) -> DataFrame:
    """The rows that a log of deltas leaves."""
    columns = [c for c in deltas.columns if c not in ("change", "epoch")]
    left = deltas.groupBy(*columns).agg(F.sum("change").alias("_n")).where("_n > 0")
    return left.withColumn("_each", F.explode(F.sequence(F.lit(1).cast("bigint"), "_n"))).select(columns)


def incremental_rescore(evidence: DataFrame, pairs: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Re-scores only the (user, restaurant) pairs whose restaurant got new evidence.

    ``score`` maps the touched pairs to assessments, from all evidence so far. Of every touched pair the assessment that no longer holds is
    withdrawn and the new one added, in one folder of deltas per epoch; a replayed epoch sees the epochs before it and writes its folder anew.
    """
    def rescore(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        restaurants = cut_lineage(batch.select("restaurant_id").distinct())
        new = score(pairs.join(restaurants, "restaurant_id", "left_semi"))
        old = _earlier(spark, path, epoch)
        old = new.limit(0) if old is None else applied(old).join(restaurants, "restaurant_id", "left_semi").select(new.columns)
        rescore_deltas(old, new).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return evidence.writeStream.foreachBatch(rescore).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _earlier(spark: SparkSession, path: str, epoch: int) -> DataFrame | None:
    """Deltas of the epochs before this one; none before the first."""
    if epoch == 0:
        return None
    return spark.read.parquet(path).where(F.col("epoch") < epoch)


def current_assessments(spark: SparkSession, path: str) -> DataFrame:
    """Assessments that hold after all epochs."""
    return applied(spark.read.parquet(path))


def compact_assessments(spark: SparkSession, path: str, target: str) -> None:
    """The log as one folder of rows that hold."""
    current_assessments(spark, path).withColumn("change", F.lit(1).cast("bigint")).write.mode("overwrite").parquet(f"{target}/epoch=0")


# --- Cache with lifetimes -----------------------------------------------------------------
_CACHE_EVENT = "namespace string, key string, at timestamp, entry_id bigint, is_negative boolean, event string"


def cache_state_stream(entries: DataFrame, negative_ttl_s: int = NEGATIVE_TTL_S, positive_ttl_s: int = POSITIVE_TTL_S) -> DataFrame:
    """The newest entry per key as state that expires in event time; emits ``stored`` and ``expired`` events.

    ``entries`` holds namespace, key, at, entry_id, is_negative. State is one entry per key; it goes, and says so, once the watermark has
    passed its lifetime. An entry older than the one held is ignored; of the same instant the larger entry_id wins.
    """
    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        def row(entry: tuple, event: str) -> pd.DataFrame:
            return pd.DataFrame({"namespace": [key[0]], "key": [key[1]], "at": [pd.Timestamp(entry[0], unit="us")], "entry_id": [entry[1]], "is_negative": [entry[2]], "event": [event]})

        held = state.get if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield row(held, "expired")
            return
        rows = pd.concat(list(batches)).sort_values(["at", "entry_id"])
        last = rows.iloc[-1]
        entry = (int(pd.Timestamp(last["at"]).value // 1000), int(last["entry_id"]), bool(last["is_negative"]))
        if held is None or entry[:2] > tuple(held)[:2]:
            if held is not None and entry[0] > _ends(held, negative_ttl_s, positive_ttl_s):
                yield row(held, "expired")
            held = entry
            state.update(held)
            yield row(held, "stored")
        state.setTimeoutTimestamp(max(_ends(held, negative_ttl_s, positive_ttl_s) // 1000, state.getCurrentWatermarkMs() + 1))

    keyed = entries.select("namespace", "key", F.col("at").cast("timestamp").alias("at"), F.col("entry_id").cast("bigint").alias("entry_id"), "is_negative")
    return keyed.withWatermark("at", WATERMARK).groupBy("namespace", "key").applyInPandasWithState(
        keep, _CACHE_EVENT, "at bigint, entry_id bigint, is_negative boolean", "append", GroupStateTimeout.EventTimeTimeout)


def _ends(entry: tuple, negative_ttl_s: int, positive_ttl_s: int) -> int:
    """Microsecond in which an entry's lifetime ends."""
    return entry[0] + (negative_ttl_s if entry[2] else positive_ttl_s) * 1_000_000


def live_entries(entries: DataFrame, as_of: Column, negative_ttl_s: int = NEGATIVE_TTL_S, positive_ttl_s: int = POSITIVE_TTL_S) -> DataFrame:
    """Batch twin of the cache state: the newest entry per key at ``as_of``, if its lifetime has not passed."""
    known = entries.where(F.col("at") <= as_of)
    latest = keep_first(known, ["namespace", "key"], [F.desc("at"), F.desc("entry_id")])
    return latest.where(F.unix_micros(as_of) - F.unix_micros("at") <= F.when(F.col("is_negative"), F.lit(negative_ttl_s * 1_000_000)).otherwise(F.lit(positive_ttl_s * 1_000_000)))
