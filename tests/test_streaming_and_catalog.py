"""Streams against their batch twins; registered queries against SQL."""

import pytest
from pyspark.sql import functions as F

from conftest import SF
from dinesight.catalog import load
from dinesight.streaming import jobs


def _events(spark, n=200):
    rows = [("a" if i % 3 else "b", i, 100_000 + i * (7 if i % 50 else 90)) for i in range(n)]
    return spark.createDataFrame(rows, "client string, event_id bigint, s bigint").withColumn("ts", F.timestamp_seconds("s")).drop("s")


def _run(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return q


def test_rate_stream_equals_batch(spark, tmp_path):
    events = _events(spark)
    events.write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "log"))
    _run(jobs.client_rate(stream, limit=4), "rate", "complete")
    want = {tuple(r) for r in jobs.client_rate(events, limit=4).collect()}
    assert {tuple(r) for r in spark.table("rate").collect()} == want and any(r[3] for r in want)


def test_admission_stream_equals_batch_and_brute_force(spark, tmp_path):
    events = _events(spark)
    events.coalesce(1).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "log"))
    _run(jobs.admission_stream(stream, limit=3), "admitted")
    batch = {r.event_id: r.admitted for r in jobs.admissions(events, limit=3).collect()}
    hits, want = {}, {}
    for r in sorted(events.select("client", "event_id", F.unix_seconds("ts").alias("t")).collect(), key=lambda r: (r.t, r.event_id)):
        live = [h for h in hits.get(r.client, []) if h > r.t - 60]
        want[r.event_id] = len(live) < 3
        hits[r.client] = live + ([r.t] if want[r.event_id] else [])
    assert batch == want and {r.event_id: r.admitted for r in spark.table("admitted").collect()} == want


def test_dedupe_and_stage_streams(spark, tmp_path):
    events = _events(spark)
    doubled = events.union(events)
    doubled.coalesce(1).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "log"))
    _run(jobs.dedupe(stream, ["event_id"]), "deduped")
    assert spark.table("deduped").count() == events.count()
    starts = events.select(F.col("event_id").alias("run_id"), F.lit("s").alias("stage"), F.col("ts").alias("started_at"))
    ends = starts.where("run_id % 2 = 0").select("run_id", "stage", (F.col("started_at") + F.expr("INTERVAL 1 MINUTE")).alias("done_at"))
    starts.write.parquet(str(tmp_path / "starts"))
    ends.write.parquet(str(tmp_path / "ends"))
    paired = jobs.pair_stages(spark.readStream.schema(starts.schema).parquet(str(tmp_path / "starts")), spark.readStream.schema(ends.schema).parquet(str(tmp_path / "ends")))
    _run(paired, "paired")
    assert spark.table("paired").where("status = 'done'").count() == ends.count()
    assert jobs.pair_stages(starts, ends).where("status = 'failed'").count() == starts.count() - ends.count()


def test_cache_stream_and_rescore(spark, tmp_path):
    rows = [("n", f"k{i % 5}", i, i % 2 == 0) for i in range(50)]
    entries = spark.createDataFrame(rows, "namespace string, key string, s bigint, is_negative boolean").withColumn("at", F.timestamp_seconds(F.col("s") * 3600)).drop("s")
    entries.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(entries.schema).parquet(str(tmp_path / "in"))
    jobs.cache_refresh_stream(stream, str(tmp_path / "cache"), str(tmp_path / "ck")).awaitTermination(120)
    live = jobs.read_cache(spark, str(tmp_path / "cache"), "1970-01-03 02:00:00")
    assert live.count() == 5
    assert {r.key for r in jobs.read_cache(spark, str(tmp_path / "cache"), "1970-01-05 00:00:00").collect()} == {"k0", "k2", "k4"}
    jobs.compact_cache(spark, str(tmp_path / "cache"), str(tmp_path / "compact"))
    assert spark.read.parquet(str(tmp_path / "compact")).count() == 5
    pairs = spark.createDataFrame([(1, "r1"), (2, "r2")], "user_id bigint, restaurant_id string")
    evidence = spark.createDataFrame([("r1",)], "restaurant_id string")
    evidence.write.parquet(str(tmp_path / "ev"))
    query = jobs.incremental_rescore(spark.readStream.schema(evidence.schema).parquet(str(tmp_path / "ev")), pairs,
                                     lambda touched: touched.withColumn("allergen", F.lit("nuts")), str(tmp_path / "out"), str(tmp_path / "ck2"))
    query.awaitTermination(120)
    assert [r.restaurant_id for r in jobs.current_assessments(spark, str(tmp_path / "out")).collect()] == ["r1"]


CHECKED = ["norm_key", "source_recency", "cuisine_prior", "nearby", "lookup_registry", "best_name_match", "tag_terms", "tag_terms_vocabulary", "dedupe_items_across_sources", "union_evidence",
           "collapse_components", "source_budget", "latest_valid_cache", "attempts_last_60s", "extract_links", "allergen_grid_long", "schema_menu_items", "score_nuts", "diet_assessment",
           "menu_summary", "safety_eval", "client_rate"]


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    import duckdb

    from dinesight.check import TABLES, _rows
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    entry = load()[name]
    df = entry.run(spark, SF)
    res = con.execute(entry.sql)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows([d[0] for d in res.description], res.fetchall())


def test_catalog_covers_inventory():
    covered = {c for e in load().values() for c in e.covers}
    assert len(load()) > 200 and {"JN-1", "RS-2", "TX-9", "ST-2", "WI-10", "AG-21"} <= covered


@pytest.mark.parametrize("slice_rows", [1_000_000, 700])
def test_admissions_of_crowded_clients(spark, slice_rows):
    """A flood, busy stretches with pauses, many attempts in one instant; pieces whole and cut in slices."""
    import random
    draw = random.Random(5)
    rows, t = [], 0
    for k in range(6000):
        t += draw.choice([0, 0, 1, 2]) if k % 2000 < 1500 else draw.choice([5, 20, 59, 60, 61, 130])
        rows.append(("flood" if k % 3 else "other", k, t))
    rows += [("instant", 10_000 + k, 100 + (k // 400) * 30) for k in range(1600)]
    rows += [("calm", 20_000 + k, k * 61) for k in range(50)]
    draw.shuffle(rows)
    log = spark.createDataFrame(rows, "client string, event_id bigint, s bigint").select("client", "event_id", F.timestamp_seconds("s").alias("ts"))
    got = {r.event_id: r.admitted for r in jobs.admissions(log, limit=7, slice_rows=slice_rows).collect()}
    hits, want = {}, {}
    for client, event, at in sorted(rows, key=lambda r: (r[2], r[1])):
        live = [h for h in hits.get(client, []) if h > at - 60]
        want[event] = len(live) < 7
        hits[client] = live + ([at] if want[event] else [])
    assert got == want and set(want.values()) == {True, False}
    assert jobs.admissions(log.where("false"), slice_rows=slice_rows).collect() == []


def test_cache_entries_expire_in_event_time(spark, tmp_path):
    """Positive and negative entries leave the state when the log passes their lifetime, however fast it is read."""
    batches = [[("n", "good", 0, 1, False), ("n", "bad", 0, 2, True), ("n", "kept", 0, 3, False)], [("n", "kept", 5_000, 4, False), ("n", "kept", 4_000, 5, True)],
               [("n", "other", 9_000, 6, False)], [("n", "other", 40_000, 7, True)], [("n", "last", 41_000, 8, False)]]
    schema = "namespace string, key string, s bigint, entry_id bigint, is_negative boolean"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).withColumn("at", F.timestamp_seconds(F.col("s") + 86_400)).drop("s").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"batch={k}"))
    given = spark.read.parquet(str(tmp_path / "in")).drop("batch")
    stream = spark.readStream.schema(given.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in") + "/*")
    _run(jobs.cache_state_stream(stream, negative_ttl_s=3_000, positive_ttl_s=30_000), "cache_events")
    events = [(r.key, r.entry_id, r.event) for r in spark.table("cache_events").collect()]
    assert sorted(e for e in events if e[2] == "stored") == sorted([("good", 1, "stored"), ("bad", 2, "stored"), ("kept", 3, "stored"), ("kept", 4, "stored"), ("other", 6, "stored"),
                                                                    ("other", 7, "stored"), ("last", 8, "stored")])
    expired = {e[:2] for e in events if e[2] == "expired"}
    assert {("good", 1), ("bad", 2), ("kept", 4), ("other", 6)} <= expired and ("last", 8) not in expired and ("kept", 3) not in expired
    at = {"early": "1970-01-02 00:40:00", "late": "1970-01-02 11:25:00"}
    live = {name: sorted(r.entry_id for r in jobs.live_entries(given, F.lit(t).cast("timestamp"), 3_000, 30_000).collect()) for name, t in at.items()}
    assert live == {"early": [1, 2, 3], "late": [7, 8]}


def test_rescoring_in_batches_equals_one_computation(spark, tmp_path):
    import random
    draw = random.Random(2)
    pairs = spark.createDataFrame([(u, f"r{k}") for u in range(6) for k in range(8) if (u + k) % 3], "user_id bigint, restaurant_id string")
    notes = [(f"r{draw.randrange(8)}", draw.randrange(100)) for _ in range(60)]
    for k in range(4):
        spark.createDataFrame(notes[k * 15:(k + 1) * 15], "restaurant_id string, weight int").coalesce(1).write.parquet(str(tmp_path / "ev" / f"batch={k}"))
    every = spark.read.parquet(str(tmp_path / "ev")).drop("batch")

    def score(touched):
        # A restaurant with few notes has no assessment, one with many loses that of the heavy kind: rows come and go.
        rolled = every.groupBy("restaurant_id").agg(F.count("*").alias("n"), F.max("weight").alias("top"))
        return touched.join(rolled.where("n % 5 <> 0"), "restaurant_id").select("user_id", "restaurant_id", F.lit("nuts").alias("allergen"), "n", F.when(F.col("top") < 90, F.col("top")).alias("top"))

    stream = spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ev") + "/*")
    out = str(tmp_path / "out")
    jobs.incremental_rescore(stream, pairs, score, out, str(tmp_path / "ck")).awaitTermination(240)
    want = sorted(map(tuple, score(pairs).collect()), key=repr)
    assert want and sorted(map(tuple, jobs.current_assessments(spark, out).collect()), key=repr) == want
    jobs.compact_assessments(spark, out, str(tmp_path / "compact"))
    assert sorted(map(tuple, jobs.current_assessments(spark, str(tmp_path / "compact")).collect()), key=repr) == want
    before, after = (spark.createDataFrame(rows, "a int, b string") for rows in ([(1, None), (2, "x"), (2, "x")], [(1, None), (2, "x"), (3, "y")]))
    assert sorted(map(tuple, jobs.rescore_deltas(before, after).collect())) == [(2, "x", -1), (3, "y", 1)]
