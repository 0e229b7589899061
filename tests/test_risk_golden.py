"""Golden tiers and risks, and the safety contract on labelled cases."""

import pytest
from pyspark.sql import functions as F

from dinesight.operators import risk

ITEMS = """restaurant_id string, item_name string, description string, extraction_method string, allergen_terms array<string>,
    cross_contact_terms array<string>, matrix_allergen_columns array<string>, menu_source_url string, arrival bigint"""
RESTAURANTS = "restaurant_id string, cuisines array<string>, region string, official_domain string, " + ", ".join(f"{s} boolean" for s in risk.SIGNALS)
PREFS = "user_id bigint, pref_ord int, allergen string, severity string, cross_contact string, nut_types array<string>"
COMMUNITY = "restaurant_id string, type string, allergen string, quote string, age_days int"


def run(spark, cases, prefs, kb=None):
    """cases: name -> dict(cuisines, region, items=[(name, terms, columns, method, cross)], signals, community)."""
    items, rests, comm = [], [], []
    for name, c in cases.items():
        signals = c.get("signals", {})
        rests.append((name, c["cuisines"], c.get("region", "US"), c.get("official", ""), *[bool(signals.get(s)) for s in risk.SIGNALS]))
        for i, it in enumerate(c.get("items", [])):
            dish, terms, columns, method, cross = (*it, *["", [], [], "gemini_text", []][len(it):])
            items.append((name, dish, "", method, terms, cross, columns, c.get("url", ""), i))
        comm += [(name, *row) for row in c.get("community", [])]
    pairs = spark.createDataFrame([(p[0], n) for p in {p[0]: p for p in prefs}.values() for n in cases], "user_id bigint, restaurant_id string")
    return risk.score(pairs, spark.createDataFrame(prefs, PREFS), spark.createDataFrame(rests, RESTAURANTS), spark.createDataFrame(items, ITEMS),
                      spark.createDataFrame(comm, COMMUNITY), 2026, kb=kb)


M, FULL = "allergen_matrix", ["milk", "gluten", "egg", "sesame", "peanut", "tree nut"]
FISHY, BAKE = ["egg", "shellfish", "fish", "gluten", "milk", "sesame"], ["gluten", "milk", "egg", "sesame"]
PARITY = {
    "Trattoria Milano": dict(cuisines=["italian"], items=[("Fettuccine Alfredo", ["milk", "gluten"], FULL, M), ("Garden Salad", [], FULL, M), ("Margherita Pizza", ["milk", "gluten"], FULL, M)]),
    "Bangkok Kitchen": dict(cuisines=["thai"], items=[("Pad Thai", ["peanut", "egg"], FULL, M), ("Tom Yum Soup", ["fish"], FULL, M), ("Som Tam (Papaya Salad)", ["peanut"], FULL, M)]),
    "Green Leaf Vegan Cafe": dict(cuisines=["vegan", "american"], items=[("Buddha Bowl", ["sesame"], FULL, M), ("Cashew Cheese Plate", ["tree nut"], FULL, M), ("Lentil Soup", [], FULL, M)]),
    "Downtown Burger Joint": dict(cuisines=["american"], items=[("Beef Burger", ["milk", "gluten", "sesame"], FULL, M), ("Crispy Fries", [], FULL, M), ("Chicken Caesar Salad", ["egg", "milk", "fish"], FULL, M)]),
    "Sakura Sushi": dict(cuisines=["japanese"], items=[("California Roll", ["shellfish", "egg"], FISHY, M), ("Peanut Sauce Udon", ["peanut", "gluten"], FISHY, M), ("Edamame", [], FISHY, M)]),
    "Bavarian Bakery": dict(cuisines=["german"], items=[("Pretzel", ["gluten"], BAKE, M), ("Black Forest Cake", ["milk", "egg", "gluten", "tree nut"], [*BAKE, "tree nut"], M), ("Sesame Seed Roll", ["sesame", "gluten"], BAKE, M)]),
    "No Menu Diner": dict(cuisines=["american"]),
}
EXPECTED = {"Bangkok Kitchen": ("avoid", 0.9), "Bavarian Bakery": ("avoid", 0.9), "Downtown Burger Joint": ("caution", 0.2), "Green Leaf Vegan Cafe": ("avoid", 0.95),
            "No Menu Diner": ("caution", 0.2), "Sakura Sushi": ("avoid", 0.97), "Trattoria Milano": ("caution", 0.2)}


def test_parity_rows(spark):
    out = run(spark, PARITY, [(1, 0, "nuts", "anaphylaxis", None, None)])
    assert {r.restaurant_id: (r.tier, r.risk) for r in out.collect()} == EXPECTED


CHART = ["peanut", "tree nut", "milk", "egg", "soy", "gluten"]
LABELLED = {
    "satay chart +": dict(cuisines=["thai"], items=[("Chicken Satay", ["peanut"], CHART, M), ("Steamed Rice", [], CHART, M)]),
    "pesto text +": dict(cuisines=["italian"], items=[("Pesto Genovese", ["pine nut", "walnut"])]),
    "navigable chart +": dict(cuisines=["japanese", "asian"], region="GB", items=[("Pad Thai", ["peanut"], CHART, M)] + [(d, [], CHART, M) for d in ("Chicken Katsu", "Edamame", "Miso Soup", "Steamed Gyoza")]),
    "clean chart -": dict(cuisines=["american"], items=[("Burger", ["milk", "egg"], CHART, M), ("Fries", [], CHART, M)]),
    "nut-free bakery -": dict(cuisines=["bakery"], signals={"nut_free_claim": True, "allergy_disclaimer": True}),
    "vegan trap +": dict(cuisines=["vegan"], items=[("Cashew Cheese Pizza", []), ("Garden Salad", []), ("Almond-milk Latte", [])]),
    "adverse report +": dict(cuisines=["chinese"], community=[("adverse_event", "nuts", "had a reaction", 40)]),
    "cross contact bakery +": dict(cuisines=["bakery"], signals={"cross_contact_warning": True}, items=[("Sourdough", []), ("Baguette", [])]),
    "thai only +": dict(cuisines=["thai"]), "bbq only -": dict(cuisines=["bbq"]),
}


def test_no_false_negatives(spark):
    out = {r.restaurant_id: r for r in run(spark, LABELLED, [(1, 0, "nuts", "allergy", None, None)]).collect()}
    assert [n for n, r in out.items() if n.endswith("+") and r.tier == "likely_ok"] == []
    assert [n for n, r in out.items() if n.endswith("-") and r.tier == "avoid"] == []
    assert out["navigable chart +"].navigable and out["navigable chart +"].tier == "caution"


def test_prior_alone_caps_at_caution_and_presence_dominates(spark):
    cases = {"prior": dict(cuisines=["thai"]), "hit": dict(cuisines=["bbq"], signals={"nut_free_claim": True}, items=[("Ribs", ["peanut"])]),
             "uncovered": dict(cuisines=["american"], items=[("Roll", [], ["milk", "egg", "soy"], M)])}
    out = {r.restaurant_id: r for r in run(spark, cases, [(1, 0, "nuts", "anaphylaxis", None, None)]).collect()}
    assert out["prior"].tier == "caution" and out["hit"].tier == "avoid" and out["hit"].risk >= 0.8
    # A chart without a nut column says nothing about nuts.
    assert out["uncovered"].basis != "allergen_matrix"


def test_specific_nuts(spark):
    cases = {"almond": dict(cuisines=["american"], items=[("Cake", ["almond"])]), "walnut": dict(cuisines=["american"], items=[("Slaw", ["walnut"])]),
             "family": dict(cuisines=["american"], items=[("Mix", ["tree nut"])])}
    out = {r.restaurant_id: r for r in run(spark, cases, [(1, 0, "nuts", "allergy", None, ["almond"])]).collect()}
    assert out["almond"].tier == "avoid" and out["family"].tier == "avoid" and out["walnut"].tier != "avoid"


@pytest.mark.parametrize("extra", [[("adverse_event", "nuts", "q", 10)], [("poor_handling", None, "q", 10)], [("good_handling", None, "q", 10)]])
def test_community_never_lowers(spark, extra):
    base = {"r": dict(cuisines=["italian"], items=[("Risotto", [])])}
    more = {"r": dict(base["r"], community=extra)}
    prefs = [(1, 0, "nuts", "allergy", None, None)]
    assert run(spark, more, prefs).first().risk >= run(spark, base, prefs).first().risk


def test_generic_allergen_uses_kb_and_chart(spark):
    kb = [{"allergen": "milk", "pattern": "alfredo", "risk": 0.95, "note": "cream", "ord": 0}]
    cases = {"kb": dict(cuisines=["american"], items=[("Pasta Alfredo", [])]), "chart": dict(cuisines=["american"], items=[("Toast", ["Dairy"], ["milk", "egg", "soy"], M)]),
             "clean": dict(cuisines=["american"], items=[("Toast", [], ["milk", "egg", "soy"], M)])}
    out = {r.restaurant_id: r for r in run(spark, cases, [(1, 0, "milk", "allergy", None, None)], kb).collect()}
    assert out["kb"].basis == "dish_prior" and out["chart"].tier == "avoid" and out["clean"].basis == "allergen_matrix"


def test_rollup_takes_worst(spark):
    rows = [(1, "r", 0, "nuts", 0.5, 0.6, "caution", "x", False), (1, "r", 1, "milk", 0.3, 0.9, "avoid", "y", True)]
    df = spark.createDataFrame(rows, "user_id bigint, restaurant_id string, pref_ord int, allergen string, risk double, confidence double, tier string, basis string, community_reported boolean")
    r = risk.profile_rollup(df).first()
    assert (r.tier, r.evidence_basis, r.overall_risk, r.community_reported) == ("avoid", "y", 0.5, True)


def test_nut_label(spark):
    df = spark.createDataFrame([("nuts", ["almond"]), ("nuts", ["pecan", "almond"]), ("nuts", None)], "a string, n array<string>")
    labels = [r[0] for r in df.select(risk.nut_label(F.col("a"), F.col("n"))).collect()]
    assert labels == ["almonds", "almonds & pecans", "nuts"]


def test_masks_agree_with_the_terms(spark):
    """Bits of a dish tested against a class say the same as the lists of its terms."""
    words = ["peanut", "tree nut", "almond", "walnut oil", "almond and cashew", "mixed nuts", "coconut", "nutmeg", "nut", "peanut and pecan", "milk", "may contain milk", "egg",
             "traces of soy", "tree nut egg", "Groundnut", "marzipan", "pine nut", "dairy", "sesame seeds"]
    sets = [[w] for w in words] + [[words[i], words[(i * 7 + 3) % 20], words[(i * 3 + 5) % 20]] for i in range(20)] + [[], None]
    items = spark.createDataFrame([("r", f"Dish number {i}", "", "gemini_text", t, sets[(i * 5 + 1) % len(sets)], [], "u", i) for i, t in enumerate(sets)], ITEMS)
    prefs = [("nuts", None), ("peanuts", None), ("tree_nuts", None), ("nuts", ["almond"]), ("nuts", ["peanuts"]), ("nuts", ["cashew", "pecan", "peanuts"]), ("milk", None), ("egg", None),
             ("soy", None), ("tree_nut", None), ("peanut", None), ("unknown", None)]
    classes = risk.with_class(spark.createDataFrame(prefs, "allergen string, nut_types array<string>")).withColumn("restaurant_id", F.lit("r"))
    rests = spark.createDataFrame([("r", ["thai"], "US", "", *[False] * len(risk.SIGNALS))], RESTAURANTS)
    got = {(r["class_key"], r["name"]): r for r in risk.dish_evidence(items, rests, classes, 2026).collect()}
    is_nut = F.col("allergen").isin(risk.NUT_KEYS)
    own, cross = risk.term_facts(F.col("allergen_terms")), risk.term_facts(F.col("cross_contact_terms"))
    nut, nut_cross = (risk.split_nut_terms(f, F.col("families"), F.col("nut_types")) for f in (own, cross))
    other, other_cross = (risk.split_allergen_terms(f, F.col("allergen")) for f in (own, cross))
    want = items.join(classes, "restaurant_id").select(
        "class_key", "item_name", (F.size(F.when(is_nut, nut["contains"]).otherwise(other["contains"])) > 0).alias("hit"),
        F.when(is_nut, F.size(nut_cross["contains"]) > 0).otherwise((F.size(other["cross"]) > 0) | (F.size(other_cross["contains"]) > 0)).alias("cross"),
        (is_nut & (F.size(nut["other"]) > 0)).alias("other")).collect()
    assert len(want) == len(got) == len(sets) * len(prefs)
    for r in want:
        mine = got[r["class_key"], r["item_name"]]
        assert (mine["text_hit"], mine["cross_hit"], mine["other_nuts"]) == (r["hit"], r["cross"], r["other"]), (r, mine)
    assert {r["hit"] for r in want} == {r["cross"] for r in want} == {r["other"] for r in want} == {True, False}
