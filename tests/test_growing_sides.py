"""Users, restaurants and their lists grow with the data: no join sends one of them whole to the driver."""

import re

import pytest

from dinesight.operators import reports, risk
from dinesight.plans import ranking as plan

from tests.test_risk_golden import COMMUNITY, ITEMS, PREFS as PREF_ROWS, RESTAURANTS
from tests.test_shared_work import scored

SF = "/root/testdata/sf0.001"
PREFS = [(1, 0, "nuts", "allergy", None, None), (1, 1, "milk", "allergy", None, None), (2, 0, "nuts", "intolerance", None, ["almond"])]


def broadcast_keys(df):
    """Left keys of the broadcast joins that a frame is planned with."""
    return sorted({k for keys in re.findall(r"BroadcastHashJoin \[([^]]*)\]", df._jdf.queryExecution().sparkPlan().toString()) for k in re.findall(r"(\w+)#", keys)})


@pytest.fixture
def planned(monkeypatch):
    """Keys of the broadcast joins of every table that the risk steps write."""
    keys, written = set(), risk.written
    monkeypatch.setattr(risk, "written", lambda df: (keys.update(broadcast_keys(df)), written(df))[1])
    return keys


def test_scores(spark, planned):
    out = scored(spark, PREFS)
    assert out.count() == 6
    # Different prefs, texts and term sets are few and written before they are joined.
    assert planned | set(broadcast_keys(out)) <= {"pref_key", "text", "terms"}


def test_requests_are_found_once(spark, monkeypatch):
    """Users meet their pairs once, not once more per step of the evidence."""
    plans, written = [], risk.written
    monkeypatch.setattr(risk, "written", lambda df: (plans.append(df._jdf.queryExecution().sparkPlan().toString()), written(df))[1])
    plans.append(scored(spark, PREFS)._jdf.queryExecution().sparkPlan().toString())
    assert sum(p.count("Join [user_id") for p in plans) == 1


def test_verdicts_in_order_lie_side_by_side(spark):
    """Long texts are the same for many users; one after another they take little room."""
    users = range(60)
    pairs = spark.createDataFrame([(u * 37 % 60, r) for u in users for r in "abcdef"], "user_id bigint, restaurant_id string")
    prefs = spark.createDataFrame([(u, 0, "nuts", ["allergy", "intolerance"][u % 2], None, None) for u in users], PREF_ROWS)
    rests = spark.createDataFrame([(r, ["thai"], "US", "", *[False] * len(risk.SIGNALS)) for r in "abcdef"], RESTAURANTS)
    args = (rests, spark.createDataFrame([], ITEMS), spark.createDataFrame([], COMMUNITY), 2026)
    told = lambda verdicts: verdicts.select("restaurant_id", "pref_key", plan.F.concat("restaurant_id", "severity").alias("text"))
    out = risk.score(pairs, prefs, *args, told=told, in_order=True)
    rows = [r.text for r in out.coalesce(1).collect()]
    assert len(rows) == 360 and sum(a != b for a, b in zip(rows, rows[1:])) == 11
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, risk.score(pairs, prefs, *args, told=told).collect()))


@pytest.mark.parametrize("query", ["rank_for_user", "score_prefs"])
def test_scored_queries(spark, planned, query):
    from dinesight.catalog import scoring_queries

    out = getattr(scoring_queries, query)(spark, SF)
    assert planned | set(broadcast_keys(out)) <= {"pref_key", "text", "terms"}


def test_rank_has_a_row_per_row_of_the_restaurant(spark):
    """Qualities travel with the verdicts; a restaurant listed twice is still ranked twice."""
    rows = [(1, "a", 0, 0.5, "caution", "menu", 0.5, "nuts", False, q) for q in ([(0.2,), (0.9,)],)] + [(1, "b", 0, 0.5, "caution", "menu", 0.5, "nuts", False, [(0.5,)])]
    told = spark.createDataFrame(rows, "user_id bigint, restaurant_id string, pref_ord int, risk double, tier string, basis string, confidence double, allergen string, community_reported boolean, "
                                       "qualities array<struct<quality: double>>")
    out = risk.rank_for_user(plan.rolled_with_quality(told), plan.F.col("quality")).orderBy("position").collect()
    assert [(r.restaurant_id, r.quality, r.position) for r in out] == [("a", 0.9, 1), ("b", 0.5, 2), ("a", 0.2, 3)]


def test_dossier(spark):
    places = spark.createDataFrame([("a", "a", "a", "w", "p", ["c"])], "restaurant_id string, name string, address string, website_url string, phone_number string, categories array<string>")
    verdicts = spark.createDataFrame([(1, "a", 0.5, 0.5, "avoid", "menu")], "user_id bigint, restaurant_id string, overall_risk double, overall_confidence double, tier string, evidence_basis string")
    watch = spark.createDataFrame([("a", 1, "Satay", 0.9)], "restaurant_id string, position int, name string, risk double")
    lists = {"quotes": spark.createDataFrame([("a", 1, "q")], "restaurant_id string, position int, quote string"), "sources": spark.createDataFrame([("a", "u")], "restaurant_id string, source_url string")}
    out = reports.dossier(places, verdicts, watch, spark.createDataFrame([("a", True)], "restaurant_id string, ask_staff boolean"),
                          spark.createDataFrame([("a", 3)], "restaurant_id string, parsed bigint"), **lists)
    assert broadcast_keys(out) == [] and out.count() == 1


def test_requested_pairs(spark):
    assert broadcast_keys(plan.requested_pairs(spark, SF)) == []
