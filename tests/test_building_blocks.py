"""Skew-safe building blocks against brute force."""

import math
import random

from pyspark.sql import functions as F

from dinesight.operators import common
from dinesight.operators.components import components as common_components
from dinesight.operators.entities import match_entities
from dinesight.operators.evaluation import spearman


def test_numbered_and_prefix_budget(spark):
    rows = [("hot" if i % 3 else f"k{i % 7}", i, (i * 37) % 50 + 1) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, o bigint, a int")
    got = {(r.k, r.o): r.n for r in common.numbered(df, ["k"], "o", "n", width=100).collect()}
    seen, total, kept = {}, {}, set()
    for k, o, a in rows:
        seen[k] = seen.get(k, 0) + 1
        assert got[(k, o)] == seen[k]
        if total.get(k, 0) < 500:
            kept.add((k, o))
        total[k] = total.get(k, 0) + a
    out = common.prefix_budget(df, ["k"], [F.asc("o")], F.col("a"), 500)
    assert {(r.k, r.o) for r in out.collect()} == kept


def test_carry_forward(spark):
    random.seed(5)
    rows = [("hot" if i % 3 else "cold", random.randrange(40_000), i, i if random.random() < 0.2 else None) for i in range(1500)]
    df = spark.createDataFrame(rows, "k string, s bigint, i bigint, v bigint").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.i: r.c for r in common.carry_forward(df, ["k"], "ts", ["ts", "i"], F.col("v"), "c", width_s=900).collect()}
    last = {}
    for k, s, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        last[k] = v if v is not None else last.get(k)
        assert got[i] == last[k]


def test_spearman_ties(spark):
    x = [1.0, 2.0, 2.0, 3.0, 5.0, 5.0, 5.0]
    y = [2.0, 1.0, 4.0, 4.0, 6.0, 5.0, 9.0]

    def ranks(v):
        return [sum(o < a for o in v) + (sum(o == a for o in v) + 1) / 2 for a in v]

    rx, ry = ranks(x), ranks(y)
    mx, my = sum(rx) / 7, sum(ry) / 7
    want = sum((a - mx) * (b - my) for a, b in zip(rx, ry)) / math.sqrt(sum((a - mx) ** 2 for a in rx) * sum((b - my) ** 2 for b in ry))
    got = spearman(spark.createDataFrame(list(zip(x, y)), "x double, y double"), "x", "y").first()
    assert abs(got.rho - want) < 1e-9


def _haversine(a, b):
    p1, p2 = math.radians(a[0]), math.radians(b[0])
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 6_371_000 * 2 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def test_match_entities_is_greedy(spark):
    random.seed(11)
    rows = []
    for i in range(400):
        name = ["Joe's Diner", "JOES DINER", "Cafe X", None, "!!"][random.choice([0, 0, 1, 2, 3, 4])]
        # A dense cluster, exact copies, and points around the date line.
        lat = 37.0 + random.randrange(40) * 0.0002
        lon = random.choice([-122.0 + random.randrange(40) * 0.0002, 179.9995, -179.9999])
        rows.append((i, name, lat, lon))
    groups, want = [], {}
    for i, name, lat, lon in rows:
        key = "".join(ch for ch in (name or "").lower() if ch.isascii() and ch.isalnum())
        home = next((g for g in groups if key and g[0] == key and _haversine((lat, lon), g[1]) <= 75), None)
        if home is None:
            home = (key, (lat, lon), i)
            groups.append(home)
        want[i] = home[2]
    df = spark.createDataFrame(rows, "ordinal bigint, name string, latitude double, longitude double")
    # All in one walk, names split into components, and components too large for one task.
    for walked in (20_000, 60, 8):
        got = {r.ordinal: r.group_id for r in match_entities(df, "ordinal", walked=walked).collect()}
        assert got == want, walked


def test_long_chain_is_walked_at_once(spark, caplog):
    """10,000 places in a row, 40 m apart: each lies in reach of the next, and no round is needed."""
    step = 40 / 111194.9266
    rows = spark.range(10_000).selectExpr("id AS ordinal", "'Chain' AS name", f"10.0D + id * {step!r}D AS latitude", "20.0D AS longitude")
    with caplog.at_level("INFO", logger="dinesight.operators.entities"):
        got = {r.ordinal: r.group_id for r in match_entities(rows, "ordinal").collect()}
    assert got == {i: i - i % 2 for i in range(10_000)} and not caplog.records
    with caplog.at_level("INFO", logger="dinesight.operators.entities"):
        split = {r.ordinal: r.group_id for r in match_entities(rows.where("ordinal % 100 < 88"), "ordinal", walked=500).collect()}
    assert split == {i: i - i % 100 % 2 for i in range(10_000) if i % 100 < 88} and not caplog.records


def test_places_without_coordinates_stay_alone(spark):
    rows = [(0, "A", None, 1.0), (1, "A", None, 1.0), (2, "A", float("nan"), 1.0), (3, "A", 95.0, 1.0), (4, "A", 5.0, 1.0), (5, "a", 5.0, 1.0), (6, None, 5.0, 1.0), (7, "", 5.0, 1.0)]
    df = spark.createDataFrame(rows, "ordinal bigint, name string, latitude double, longitude double")
    assert {r.ordinal: r.group_id for r in match_entities(df, "ordinal").collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7}
    assert match_entities(df.where("false"), "ordinal").collect() == []


def test_components(spark):
    random.seed(3)
    nodes = list(range(300))
    random.shuffle(nodes)
    edges = [(nodes[i], nodes[i + 1]) for i in range(150)] + [(nodes[200], n) for n in nodes[201:260]] + [(nodes[290], nodes[291]), (nodes[291], nodes[290]), (nodes[299], nodes[299])]
    label = {}
    for part in (nodes[:151], nodes[200:260], nodes[290:292]):
        label |= dict.fromkeys(part, min(part))
    got = {r.node: r.label for r in common_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == label and common_components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_representative_not_chain(spark):
    step = 50 / 111194.9266
    df = spark.createDataFrame([(i, "Same Name", 10.0 + i * step, 20.0) for i in (0, 1)] + [(2, "Same Name", 10.0 + 2 * step, 20.0), (3, "Same Name", 10.0 + 2.6 * step, 20.0)],
                               "ordinal bigint, name string, latitude double, longitude double")
    assert {r.ordinal: r.group_id for r in match_entities(df, "ordinal").collect()} == {0: 0, 1: 0, 2: 2, 3: 2}


def test_keep_first_prunes_before_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    plan = common.keep_first(df, ["k"], [F.asc("id")])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_nearby_is_dealt_out(spark):
    """One file and one crowded spot do not leave all pairs to one task; the rows are those of a plain comparison."""
    from dinesight.functions.geo import haversine_m
    from dinesight.operators.entities import nearby
    spots = spark.range(3000).selectExpr("concat('p', id) AS restaurant_id", "CAST(37.0 + IF(id < 2000, 0, (id % 100) / 10000) AS DOUBLE) AS latitude",
                                         "CAST(-122.0 + IF(id < 2000, 0, (id % 70) / 10000) AS DOUBLE) AS longitude").coalesce(1)
    origins = spark.range(20).selectExpr("concat('o', id) AS origin_id", "CAST(37.0 + id / 5000 AS DOUBLE) AS latitude", "CAST(-122.0 + id / 7000 AS DOUBLE) AS longitude").coalesce(1)
    found = nearby(origins, spots, 400.0).withColumn("task", F.spark_partition_id())
    rows = found.collect()
    other = origins.withColumnsRenamed({"latitude": "a", "longitude": "b"}).crossJoin(spots)
    metres = haversine_m(F.col("a"), F.col("b"), F.col("latitude"), F.col("longitude"))
    want = {(r[0], r[1]): r[2] for r in other.withColumn("m", metres).where("m <= 400").select("origin_id", "restaurant_id", "m").collect()}
    assert {(r["origin_id"], r["restaurant_id"]): r["distance_m"] for r in rows} == want and len(rows) == len(want) > 0
    assert len({r["task"] for r in rows}) > 1
