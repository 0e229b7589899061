"""Nested documents: every block, bounded lists, and nothing made up where evidence is missing."""

import json

from pyspark.sql import functions as F

from dinesight.operators import reports
from dinesight.operators.evidence import community_diets


def test_dossier_blocks(spark):
    rests = spark.createDataFrame([("a", "A", "1 Main", None, "+1", ["cafe"]), ("b", "B", None, "https://b", None, [])],
                                  "restaurant_id string, name string, address string, website_url string, phone_number string, categories array<string>")
    verdicts = spark.createDataFrame([(1, "a", 0.9, 0.8, "avoid", "allergen_matrix"), (2, "a", 0.2, 0.5, "likely_ok", None)],
                                     "user_id int, restaurant_id string, overall_risk double, overall_confidence double, tier string, evidence_basis string")
    watch = spark.createDataFrame([("a", k, f"d{k:02d}", 0.5) for k in range(30)], "restaurant_id string, position int, name string, risk double")
    signals = spark.createDataFrame([("a", True)], "restaurant_id string, ask_staff boolean")
    quotes = spark.createDataFrame([("a", k // 2, f"q{k:02d}") for k in range(40)], "restaurant_id string, position int, quote string")
    items = spark.createDataFrame([("a", 30), ("a", 12)], "restaurant_id string, parsed int")
    site = spark.createDataFrame([("a", 3, ["s"], ["https://x"], None)], "restaurant_id string, pages_scanned int, signals array<string>, social_links array<string>, error string")
    notices = spark.createDataFrame([("b", "from GB", None)], "restaurant_id string, region_notice string, location_notice string")
    sources = spark.createDataFrame([("a", f"u{k % 50}") for k in range(200)], "restaurant_id string, source_url string")
    each = spark.createDataFrame([(1, "a", "milk", "avoid", 0.9), (1, "a", "egg", "caution", 0.4), (2, "a", "egg", "likely_ok", 0.1)], "user_id int, restaurant_id string, allergen string, tier string, risk double")
    full = {(r["user_id"], r["restaurant_id"]): r for r in reports.dossier(rests, verdicts, watch, signals, items, site, quotes, sources, notices, each).collect()}
    one, none = full[1, "a"], full[None, "b"]
    assert len(full) == 3 and one["verdict"]["tier"] == "avoid" and full[2, "a"]["verdict"]["basis"] == ""
    assert [w["name"] for w in one["dishes"]["watch"]] == [f"d{k:02d}" for k in range(8)] and one["dishes"]["n_watch"] == 30
    assert (one["dishes"]["parsed_count"], one["dishes"]["other_count"]) == (42, 34)
    assert one["community"]["quotes"] == [f"q{k:02d}" for k in range(12)] and one["community"]["n_quotes"] == 40
    assert len(one["provenance"]["sources"]) == 40 and one["provenance"]["n_sources"] == 50 and one["deeper_site"]["pages_scanned"] == 3
    assert [p["allergen"] for p in one["provenance"]["per_allergen"]] == ["egg", "milk"] and [p["tier"] for p in full[2, "a"]["provenance"]["per_allergen"]] == ["likely_ok"]
    assert none["verdict"]["tier"] == "unknown" and not none["verdict"]["verified"] and none["dishes"]["watch"] is None and none["provenance"]["region_notice"] == "from GB"
    bare = reports.dossier(rests, verdicts.drop("user_id").where("tier = 'avoid'"), watch, signals).collect()
    assert sorted(r["restaurant_id"] for r in bare) == ["a", "b"] and "user_id" not in bare[0].asDict()


def test_bundles_by_scenario(spark):
    rests = spark.createDataFrame([("c", "Chart Cafe", ["thai"], "US", True, True), ("m", None, [], "GB", False, False), ("n", "None", ["bbq"], None, False, False)],
                                  "restaurant_id string, name string, cuisines array<string>, region string, chart boolean, ask_staff boolean")
    found = spark.createDataFrame([(1, r, "milk", "allergy", 0.4, "caution", b, 9, 2) for r, b in (("c", "allergen_matrix"), ("m", "cuisine_prior"), ("n", "cuisine_prior"))],
                                  "user_id int, restaurant_id string, allergen string, severity string, risk double, tier string, basis string, menu_total int, menu_flagged int")
    menus = spark.createDataFrame([(r, k, f"Line {k}") for r in "cm" for k in range(1, 80)], "restaurant_id string, position int, line string")
    quotes = spark.createDataFrame([("m", 2, "adverse_event", "x" * 300), ("m", 1, "good_handling", 'kind "staff"')], "restaurant_id string, position int, type string, quote string")
    flagged = spark.createDataFrame([("c", k, f"Dish {k}") for k in range(25)], "restaurant_id string, position int, name string")
    got = {r["restaurant_id"]: (r["scenario"], json.loads(r["bundle"])) for r in reports.score_bundles(found, rests, menus, quotes, flagged).collect()}
    assert {k: v[0] for k, v in got.items()} == {"c": "labeled", "m": "raw_menu", "n": "no_menu"}
    chart, raw, none = (got[k][1] for k in "cmn")
    assert chart["chart_summary"] == {"total_dishes": 9, "dishes_with_allergen": 2, "flagged_dishes": [f"Dish {k}" for k in range(20)]} and "menu" not in chart
    assert chart["deterministic_baseline"]["grounded_presence"] and [e["id"] for e in chart["evidence"]] == ["E1", "E2"] and chart["evidence"][1]["type"] == "handling"
    assert raw["menu"] == [f"Line {k}" for k in range(1, 61)] and "chart_summary" not in raw and "unknown" in raw["evidence"][0]["text"]
    assert [e["text"][:24] for e in raw["evidence"][1:]] == ['Community good_handling:', 'Community adverse_event:'] and len(raw["evidence"][2]["text"]) < 180
    assert "menu" not in none and len(none["evidence"]) == 1


def test_grounded_diet_quotes(spark):
    parsed = spark.createDataFrame([("a", "Vegan ", "many dishes can be   made vegan"), ("a", "vegan", "fully vegan menu"), ("a", "keto", "many dishes"), ("a", None, "many"), ("a", "vegetarian", ""),
                                    ("b", "vegan", "many dishes"), ("a", "vegetarian", None)], "restaurant_id string, diet string, quote string")
    snippets = spark.createDataFrame([("a", "Reviewers say many dishes\ncan be made vegan here.", "https://r.test/1")], "restaurant_id string, bundle string, url string")
    got = community_diets(parsed, snippets).collect()
    assert [(r["diet"], r["quote"], r["url"], r["source"]) for r in got] == [("vegan", "many dishes can be   made vegan", "https://r.test/1", "community")]
    assert community_diets(parsed.where(F.lit(False)), snippets).collect() == []


def test_rollup_reads_its_dishes_once(spark):
    from dinesight.operators.reports import restaurant_risk_rollup
    read = spark.sparkContext.accumulator(0)

    def counted(x):
        read.add(1)
        return x
    risk = F.udf(counted, "double")
    rows = spark.createDataFrame([("a", "x", 0.6, ["thai"]), ("a", "x", 0.2, ["thai"]), ("a", "y", 0.9, ["thai"]), ("b", None, 0.1, [])], "restaurant_id string, item_name string, r double, cuisines array<string>")
    scored = rows.withColumn("prior_risk", risk("r")).withColumn("region", F.lit("US"))
    got = {r["restaurant_id"]: (r["n_risky"], r["confidence"], r["top_items"]) for r in restaurant_risk_rollup(scored, F.col("cuisines"), F.col("region")).collect()}
    assert got == {"a": (2, 0.8, ["y", "x"]), "b": (0, 0.55, [None])}
    assert read.value == 4


def test_bundle_text_is_the_json_of_its_struct(spark):
    import json

    from dinesight.operators.reports import score_bundles
    seen = spark.createDataFrame([("u", r, "nuts", "allergy", 0.5, "avoid", None, 3, 1) for r in ("a", "b", "c")],
                                 "user_id string, restaurant_id string, allergen string, severity string, risk double, tier string, basis string, menu_total int, menu_flagged int")
    rests = spark.createDataFrame([("a", ["thai"], "US", True), ("b", [], None, False), ("c", ["thai"], "GB", False)], "restaurant_id string, cuisines array<string>, region string, chart boolean")
    menus = spark.createDataFrame([("a", 1, 'x "y"'), ("b", 1, 'p "q" é')], "restaurant_id string, position int, line string")
    out = {r["restaurant_id"]: r["bundle"] for r in score_bundles(seen, rests, menus).collect()}
    parsed = {k: json.loads(v) for k, v in out.items()}
    common = ["scenario", "user", "deterministic_baseline", "evidence"]
    assert list(parsed["a"]) == [*common, "chart_summary"] and list(parsed["b"]) == [*common, "menu"] and list(parsed["c"]) == common
    assert parsed["a"]["chart_summary"] == {"total_dishes": 3, "dishes_with_allergen": 1, "flagged_dishes": []} and parsed["b"]["menu"] == ['p "q" é']
    assert all(v == json.dumps(parsed[k], ensure_ascii=False, separators=(",", ":")) for k, v in out.items())
    assert parsed["c"]["deterministic_baseline"] == {"risk": 0.5, "tier": "avoid", "grounded_presence": False} or "grounded_presence" not in parsed["c"]["deterministic_baseline"]
