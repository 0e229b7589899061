"""Cases in which earlier versions lost rows."""

import pytest
from pyspark.sql import functions as F

from dinesight.operators import entities, extraction, risk


def test_both_knowledge_base_paths_agree(spark):
    """Null descriptions, zero risks, and a base beyond the bound of inlining."""
    rows = [("milk", "alfredo", 0.95, "n", 0), ("milk", "cream", 0.4, "n", 1), ("egg", "alfredo", 0.0, "n", 2), ("soy", "tofu", 0.8, "n", 3)]
    schema = "allergen string, pattern string, risk double, note string, ord int"
    small = spark.createDataFrame(rows, schema)
    filler = spark.range(2500).select(F.lit("egg").alias("allergen"), F.concat(F.lit("zzq"), F.col("id").cast("string")).alias("pattern"),
                                      F.lit(0.5).alias("risk"), F.lit("n").alias("note"), (F.col("id") + 10).cast("int").alias("ord"))
    items = spark.createDataFrame([("r", "Pasta Alfredo", None), ("r", "Tofu", "with cream"), ("r", "Tofu", None), ("r", None, None)],
                                  "restaurant_id string, item_name string, description string")

    def hits(kb):
        facts = risk.text_facts(items, kb).select("text", F.explode("kb_hits").alias("h")).select("text", "h.allergen", "h.risk")
        return sorted(tuple(r) for r in facts.groupBy("text", "allergen").agg(F.max("risk")).collect())
    inline, joined = hits(small), hits(small.unionByName(filler))
    assert inline == joined and ("pasta alfredo", "milk", 0.95) in [(t.lower(), a, r) for t, a, r in inline]
    assert not [h for h in inline if h[1] == "egg"]


def test_long_names_match(spark):
    long = "the restaurant with a name " * 8
    rows = spark.createDataFrame([(1, long, 5.0), (2, "Cafe X", 7.0), (3, "A cafe x bar", 1.0)], "row_id long, name string, distance_m double")
    queries = spark.createDataFrame([(1, long), (2, "x " + long), (3, "cafe x"), (4, "x")], "query_id long, query string")
    got = {(r["query_id"], r["row_id"]): r["tier"] for r in entities.name_matches(rows, queries).collect()}
    assert got[1, 1] == 1 and got[2, 1] == 3 and got[3, 2] == 1 and got[3, 3] == 3 and (4, 2) in got


@pytest.mark.parametrize(("given", "want"), [("Cr&egrave;me &#233;&#x27;s &amp;lt; x", "Crème é's &lt; x"), ("a & b &unknown; &#0; &#xD800;", "a & b &unknown; � �"),
                                             ("&notin;&nbsp;&#160;x &#128512;", "∉  x 😀"), ("plain", "plain"), ("&", "&")])
def test_character_references(spark, given, want):
    assert spark.range(1).select(extraction.decode_entities(F.lit(given))).first()[0] == want


def test_tables_beyond_forty(spark):
    table = "<table><tr><th>Dish</th><th>Milk</th><th>Egg</th><th>Soy</th></tr><tr><td>Dish number {0}</td><td>x</td><td></td><td></td></tr></table>"
    pages = spark.createDataFrame([(1, "".join(table.format(k) for k in range(60)))], "page_id long, html string")
    assert extraction.allergen_grid_long(pages).count() == 60


def test_every_start_has_its_own_completion(spark):
    from dinesight.operators.evaluation import stage_durations
    rows = [("r", "s", "stage_start", 0), ("r", "s", "stage_done", 10), ("r", "s", "stage_start", 100), ("r", "s", "stage_done", 130), ("r", "s", "stage_done", 140),
            ("r", "s", "stage_start", 9_000), ("r", "s", "stage_start", 9_500), ("r", "s", "stage_done", 90_000), ("q", "s", "stage_done", 5), ("q", "s", "stage_start", 6)]
    events = spark.createDataFrame(rows, "run_id string, stage string, kind string, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    got = sorted((r["run_id"], r["status"], r["seconds"]) for r in stage_durations(events).collect())
    assert got == sorted([("r", "done", 10.0), ("r", "done", 30.0), ("r", "failed", None), ("r", "done", 80_500.0), ("q", "failed", None)], key=lambda x: (x[0], x[1], x[2] or 0))


def test_riskiest_items_take_the_top_before_they_filter(spark):
    schema = "restaurant_id string, class_key string, name string, arrival string, prior_risk double, chart_hit boolean, risky boolean, suspected boolean"
    plain = [("r", "c", f"plain {k}", f"{k:02d}", 0.6, False, False, False) for k in range(8)]
    rows = [*plain, ("r", "c", "named", "09", 0.9, False, True, False), ("r", "c", "late suspect", "10", 0.4, False, False, True),
            ("x", "c", "b", "01", 0.2, True, True, False), ("x", "c", "a", "02", 0.9, True, True, False), ("x", "c", "z", "00", 0.99, False, True, False)]
    got = sorted((r["restaurant_id"], r["position"], r["name"], r["risk"]) for r in risk.riskiest_items(spark.createDataFrame(rows, schema)).collect())
    assert got == [("r", 1, "named", 0.9), ("x", 1, "b", 0.95), ("x", 2, "a", 0.95)]


def _script(body: str) -> str:
    return f'<html><script type="application/json">{body}</script></html>'


def test_json_is_walked_to_the_leaves(spark):
    """Items 10, 17 and 60 levels down; text nested beyond what the parser reads, broken text and null pages."""
    def sunk(body, depth):
        return '{"a":[1,' * depth + body + "]}" * depth
    rows = [(k, _script(sunk(f'{{"name":"Dish {k}","price":"{k}.5","allergens":["Milk"]}}', depth))) for k, depth in ((1, 0), (2, 5), (3, 8), (4, 30))]
    rows += [(5, _script("[" * 3000 + '{"name":"Lost","price":"1"}' + "]" * 3000)), (6, _script('{"a":[{"name":"Cut","price":"2"')), (7, None), (8, ""),
             (9, _script('[{"name":"Outer","price":"3","inner":{"name":"Outer","price":"3","inner":{"name":"Inner","price":"4","contains":["Egg"]}}}]'))]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    items = sorted((r["page_id"], r["item_name"], r["price"]) for r in extraction.embedded_json_items(pages).collect())
    assert items == [(1, "Dish 1", "$1.5"), (2, "Dish 2", "$2.5"), (3, "Dish 3", "$3.5"), (4, "Dish 4", "$4.5"), (9, "Inner", "$4"), (9, "Outer", "$3")]
    tagged = sorted((r["page_id"], r["item_name"], *r["allergen_terms"]) for r in extraction.embedded_allergen_items(pages).collect())
    assert tagged == [(k, f"Dish {k}", "milk") for k in (1, 2, 3, 4)] + [(9, "Inner", "egg")]


def test_schema_menus_nest_without_bound(spark):
    section = '{"name":"S%d","hasMenuItem":{"name":"Dish number %d","price":"%d"},"menuSection":[' * 12 % tuple(x for k in range(12) for x in (k, k, k + 1)) + "]}" * 12
    menu = '{"@graph":[[' * 9 + '{"@type":"Menu","hasMenuSection":' + section + "}" + "]]}" * 9
    pages = spark.createDataFrame([(1, f'<script type="application/ld+json">{menu}</script>')], "page_id long, html string")
    got = sorted((r["category"], r["item_name"], r["price"]) for r in extraction.schema_menu_items(pages).collect())
    assert got == sorted((f"S{k}", f"Dish number {k}", str(k + 1)) for k in range(12))


def test_charts_inside_layout_tables(spark):
    """Nested, side by side, unclosed, with stray end tags, and the same page twice."""
    def chart(dish):
        return f"<table><tr><th>Dish</th><th>Milk</th><th>Egg</th><th>Soy</th></tr><tr><td>{dish}</td><td>x</td><td></td><td>x</td></tr></table>"
    layout = "<table><tr><td>Left</td><td>%s</td></tr><tr><td>%s</td></tr></table>"
    rows = [(1, layout % (chart("Inner One"), chart("Inner Two"))), (2, layout % (layout % (chart("Deep"), ""), chart("Shallow"))), (3, "</table></table>" + chart("After strays")),
            (4, "<table><tr><td>" + chart("Unclosed around")), (5, "no tables"), (6, None), (7, chart("Plain")), (7, chart("Plain"))]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    got = sorted((r["page_id"], r["item_name"], tuple(r["allergen_terms"])) for r in extraction.allergen_grid_long(pages).collect())
    names = [(1, "Inner One"), (1, "Inner Two"), (2, "Deep"), (2, "Shallow"), (3, "After strays"), (4, "Unclosed around"), (7, "Plain")]
    assert got == [(k, name, ("milk", "soy")) for k, name in names]
