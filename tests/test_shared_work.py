"""Work that rows share is done once, whoever asks for it."""

from pyspark.sql import functions as F

from dinesight.operators import risk

from tests.test_risk_golden import COMMUNITY, ITEMS, PREFS, RESTAURANTS


def scored(spark, prefs, places=("a", "b")):
    pairs = spark.createDataFrame([(u, r) for u in sorted({p[0] for p in prefs}) for r in places], "user_id bigint, restaurant_id string")
    rests = [(r, ["thai"], "US", "", *[False] * len(risk.SIGNALS)) for r in places]
    items = [(r, dish, "", "gemini_text", terms, [], [], "", i) for r in places for i, (dish, terms) in enumerate([("Pad Thai", ["peanut"]), ("Rice", []), ("Soup", ["milk"])])]
    return risk.score(pairs, spark.createDataFrame(prefs, PREFS), spark.createDataFrame(rests, RESTAURANTS), spark.createDataFrame(items, ITEMS),
                      spark.createDataFrame([], COMMUNITY), 2026)


def test_ladder_is_climbed_once_per_pref(spark, monkeypatch):
    """Forty users with the same five prefs: five rungs a restaurant, not forty times as many."""
    kinds = [("nuts", "allergy", None, None), ("nuts", "allergy", "strict", None), ("nuts", "intolerance", None, ["almond"]), ("milk", "allergy", None, None), ("nuts", "allergy", None, ["almond"])]
    sizes, fuse = [], risk.fuse
    monkeypatch.setattr(risk, "fuse", lambda facts, *args, **kw: (sizes.append(facts.count()), fuse(facts, *args, **kw))[1])
    got = scored(spark, [(user, i, *kind) for user in range(40) for i, kind in enumerate(kinds)]).drop("user_id")
    alone = scored(spark, [(i, i, *kind) for i, kind in enumerate(kinds)]).drop("user_id")
    assert sizes[0] == 2 * len(kinds)
    rows = got.groupBy(*got.columns).count().collect()
    assert {tuple(r)[:-1] for r in rows} == {tuple(r) for r in alone.collect()} and {r["count"] for r in rows} == {40}


def test_repeated_prefs_and_nulls_keep_their_rows(spark):
    prefs = [(1, 0, "nuts", "allergy", None, None), (1, 0, "nuts", "allergy", None, None), (2, 0, "milk", None, None, None)]
    got = scored(spark, prefs, ("a",)).groupBy("user_id").agg(F.count("*").alias("n")).collect()
    assert {(r.user_id, r.n) for r in got} == {(1, 2), (2, 1)}


def test_few_texts_are_sent_to_the_dishes(spark):
    """Texts and term sets are written first, so dishes are not shuffled to meet a handful of them."""
    items = spark.range(1000).select(F.concat(F.lit("r"), (F.col("id") % 7).cast("string")).alias("restaurant_id"), F.concat(F.lit("Dish "), (F.col("id") % 9).cast("string")).alias("item_name"),
                                     F.lit("with peanuts").alias("description"), F.lit("gemini_text").alias("extraction_method"), F.array(F.when(F.col("id") % 2 == 0, "milk").otherwise("egg")).alias("allergen_terms"),
                                     F.array(F.lit("egg")).alias("cross_contact_terms"), F.expr("CAST(array() AS ARRAY<STRING>)").alias("matrix_allergen_columns"), F.col("id").alias("arrival"))
    out = risk.dish_signatures(items)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan
    assert out.count() == 63


def test_bundles_are_written_once_per_verdict(spark, monkeypatch):
    """A bundle is written per restaurant and pref, and every pair of a user and a restaurant gets its own."""
    from dinesight.catalog import report_queries
    from dinesight.plans.ranking import requested_pairs

    sizes, bundles = [], report_queries.r.score_bundles
    monkeypatch.setattr(report_queries.r, "score_bundles", lambda rows, *args, **kw: (sizes.append(rows.count()), bundles(rows, *args, **kw))[1])
    out = report_queries.score_bundles(spark, "/root/testdata/sf0.001")
    pairs = requested_pairs(spark, "/root/testdata/sf0.001").count()
    assert out.count() == pairs and sizes[0] < pairs / 2


def test_dossier_of_users_and_of_nobody(spark):
    """What a dossier tells of a restaurant is the same for each of its users, and there without any."""
    from dinesight.operators import reports

    places = spark.createDataFrame([(r, r, "a", "w", "p", ["c"]) for r in ("a", "b")], "restaurant_id string, name string, address string, website_url string, phone_number string, categories array<string>")
    verdicts = spark.createDataFrame([(u, "a", 0.5, 0.5, "avoid", "menu") for u in (1, 2)],
                                     "user_id bigint, restaurant_id string, overall_risk double, overall_confidence double, tier string, evidence_basis string")
    watch = spark.createDataFrame([(r, 1, "Satay", 0.9) for r in ("a", "b")], "restaurant_id string, position int, name string, risk double")
    signals = spark.createDataFrame([("a", True)], "restaurant_id string, ask_staff boolean")
    items = spark.createDataFrame([("a", 3), ("a", 2)], "restaurant_id string, parsed bigint")
    out = {(r.user_id, r.restaurant_id): r for r in reports.dossier(places, verdicts, watch, signals, items).collect()}
    assert set(out) == {(1, "a"), (2, "a"), (None, "b")}
    assert out[1, "a"].dishes == out[2, "a"].dishes and tuple(out[1, "a"].dishes)[1:] == (1, 5, 4)
    assert tuple(out[None, "b"].dishes)[1:] == (1, 0, 0) and not out[None, "b"].verdict.verified and out[None, "b"].verdict.tier == "unknown"
