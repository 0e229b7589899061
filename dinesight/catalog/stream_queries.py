"""Batch twins of the streaming jobs over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from dinesight.catalog import query
from dinesight.catalog.tables import table
from dinesight.session import cut_lineage
from dinesight.streaming import jobs


def _log(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 5).cast("string").alias("client"), "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")


@query("client_rate", "ST-1",
       "SELECT CAST(user_id % 5 AS VARCHAR) AS client, CAST(w / 1000000 AS BIGINT) AS window_start, count(*) AS n_requests, count(*) > 4 AS over_limit FROM (SELECT user_id, "
       "unnest(generate_series(epoch_us(ts) // 10000000 * 10000000 - 50000000, epoch_us(ts) // 10000000 * 10000000, 10000000)) AS w FROM events) GROUP BY ALL")
def client_rate(spark, sf_dir):
    out = jobs.client_rate(_log(spark, sf_dir), limit=4)
    return out.select("client", F.unix_seconds("window_start").alias("window_start"), "n_requests", "over_limit")


@query("daily_requests", "ST-3", "SELECT CAST(ts AS DATE) AS day, count(*) AS n_requests, count(*) > 330 AS over_cap FROM events GROUP BY 1")
def daily_requests(spark, sf_dir):
    return jobs.daily_requests(_log(spark, sf_dir), 330)


@query("admissions", "ST-2",
       "WITH RECURSIVE o AS (SELECT CAST(user_id % 5 AS VARCHAR) AS client, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id % 5 ORDER BY ts, event_id) AS i FROM events), "
       "w(client, i, event_id, admitted, hits) AS (SELECT client, i, event_id, true, [t] FROM o WHERE i = 1 UNION ALL "
       "SELECT client, i, event_id, len(live) < 2, CASE WHEN len(live) < 2 THEN list_append(live, t) ELSE live END FROM ("
       "SELECT o.client, o.i, o.event_id, o.t, list_filter(w.hits, lambda h: h > o.t - 600000000) AS live FROM w JOIN o ON o.client = w.client AND o.i = w.i + 1)) "
       "SELECT client, event_id, admitted FROM w")
def admissions(spark, sf_dir):
    return jobs.admissions(_log(spark, sf_dir), limit=2, window_s=600)


@query("pair_stages", "ST-5",
       "SELECT s.event_id, count(d.event_id) AS n_done FROM (SELECT * FROM events WHERE event_type = 'view') s LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') d ON s.user_id = d.user_id AND d.ts >= s.ts AND d.ts <= s.ts + INTERVAL 12 HOURS GROUP BY 1")
def pair_stages(spark, sf_dir):
    log = _log(spark, sf_dir)
    starts = log.where("event_type = 'view'").select("user_id", F.col("event_id").cast("string").alias("_id"), F.col("user_id").alias("run_id"), F.lit("visit").alias("stage"), F.col("ts").alias("started_at"))
    ends = log.where("event_type = 'purchase'").select(F.col("user_id").alias("run_id"), F.lit("visit").alias("stage"), F.col("ts").alias("done_at"))
    paired = jobs.pair_stages(starts.select("run_id", "stage", "started_at"), ends, "12 hours")
    keyed = paired.join(starts.select("run_id", "started_at", "_id"), ["run_id", "started_at"])
    return keyed.groupBy(F.col("_id").cast("bigint").alias("event_id")).agg(F.count("done_at").alias("n_done"))


_NEGATIVE, _POSITIVE = 6 * 3600, 36 * 3600


@query("live_entries", "ST-4",
       "WITH e AS (SELECT event_type AS namespace, CAST(user_id AS VARCHAR) AS key, ts AS moment, event_id AS entry_id, event_id % 3 = 0 AS is_negative FROM events), "
       "n AS (SELECT max(moment) - INTERVAL 12 HOURS AS t FROM e), l AS (SELECT e.*, t FROM e, n WHERE moment <= t QUALIFY row_number() OVER (PARTITION BY namespace, key ORDER BY moment DESC, entry_id DESC) = 1) "
       f"SELECT namespace, key, entry_id, is_negative FROM l WHERE epoch_us(t) - epoch_us(moment) <= CASE WHEN is_negative THEN {_NEGATIVE} ELSE {_POSITIVE} END * 1000000::BIGINT")
def live_entries(spark, sf_dir):
    entries = table(spark, sf_dir, "events").select(F.col("event_type").alias("namespace"), F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("at"),
                                                    F.col("event_id").alias("entry_id"), (F.col("event_id") % 3 == 0).alias("is_negative"))
    as_of = entries.agg((F.max("at") - F.expr("INTERVAL 12 HOURS")).alias("t")).first()["t"]
    return jobs.live_entries(entries, F.lit(as_of), _NEGATIVE, _POSITIVE).select("namespace", "key", "entry_id", "is_negative")


@query("rescored_in_batches", "ST-7",
       "WITH v AS (SELECT 's' || CAST(conv_id % 100 AS VARCHAR) AS restaurant_id, count(*) AS n_reports, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM conversations GROUP BY 1) "
       "SELECT user_id, v.* FROM v JOIN (SELECT DISTINCT o_custkey AS user_id, 's' || CAST(l_suppkey AS VARCHAR) AS restaurant_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey) USING (restaurant_id)")
def rescored_in_batches(spark, sf_dir):
    """Reports arrive in three batches; every batch withdraws and adds, and what is left equals one computation over all."""
    from dinesight.plans.ranking import requested_pairs
    reports = table(spark, sf_dir, "conversations").select(F.concat(F.lit("s"), (F.col("conv_id") % 100).cast("string")).alias("restaurant_id"), "text", (F.col("conv_id") * 7 % 3).alias("batch"))
    pairs = requested_pairs(spark, sf_dir)

    def score(known, touched):
        counted = known.join(touched, "restaurant_id", "left_semi").groupBy("restaurant_id").agg(F.count("*").alias("n_reports"), F.sum(F.length("text")).cast("bigint").alias("n_chars"))
        return pairs.join(counted, "restaurant_id").select("user_id", "restaurant_id", "n_reports", "n_chars")

    log = None
    for k in range(3):
        touched = reports.where(F.col("batch") == k).select("restaurant_id").distinct()
        new = score(reports.where(F.col("batch") <= k), touched)
        old = new.limit(0) if log is None else jobs.applied(log).join(touched, "restaurant_id", "left_semi").select(new.columns)
        deltas = cut_lineage(jobs.rescore_deltas(old, new))
        log = deltas if log is None else log.unionByName(deltas)
    return jobs.applied(log)
