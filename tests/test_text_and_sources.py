"""Expressions on the parametrised cases, readers and writers on small files."""

import json

import pytest
from pyspark.sql import functions as F

from dinesight.functions import text as t
from dinesight.functions import urls as u
from dinesight.operators import entities as e
from dinesight.operators import evidence as ev
from dinesight.operators import extraction as x
from dinesight.operators import tagging as tg
from dinesight.sources import places as sp
from dinesight.sources import records as rec
from dinesight.vocab import allergens as av


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_regions(spark):
    cases = [("San Jose, CA 95129", None, None, "US"), ("1 High St, London, United Kingdom", None, None, "GB"), ("Peachtree St, Atlanta, Georgia 30301", None, None, "US"),
             ("Rustaveli Ave, Tbilisi, Georgia", None, None, "GE"), ("Portland, Oregon", None, None, "US"), ("35HJ+JF - Al Thanyah Second - Dubai - United Arab Emirates", None, None, "AE"),
             ("somewhere", 37.3, -122.0, "US"), (None, None, None, "unknown"), ("Calle La Paz 5, Madrid", None, None, "unknown"), ("Stratford-upon-Avon", 52.2, -1.7, "GB")]
    got = values(spark, [c[:3] for c in cases], "a string, lat double, lon double", u.region_from_address(F.col("a"), F.col("lat"), F.col("lon")))
    assert got == [c[3] for c in cases]


def test_ingredients(spark):
    cases = {"Tahini bowl": (["sesame"], []), "eggplant parm": ([], []), "coconut milk curry": ([], []), "Gluten-free ramen": ([], []), "Pesto pasta": ([], ["tree nut"]),
             "Vegan mayo burger": ([], []), "Soy sauce eggs": (["egg", "gluten", "soy", "wheat"], []), "oyster mushroom": ([], []), "satay sauce": (["peanut"], []),
             "butter chicken with peanut butter": (["milk"], []), "peanut-free baklava": (["tree nut"], []), "shrimp paste": (["shellfish"], [])}
    got = spark.createDataFrame([(k,) for k in cases], "s string").select("s", tg.infer_allergens(F.col("s")).alias("i")).collect()
    assert {r.s: (r.i.definite, r.i.may) for r in got} == cases


def test_dish_false_friends(spark):
    names = ["Guacamole", "Chicken Mole", "Coconut Macaroon", "French Macaron", "Pad Thai"]
    hits = values(spark, [(n.lower(),) for n in names], "s string", F.size(tg.dish_hits(F.col("s"))) > 0)
    assert hits == [False, True, False, True, True]
    terms = values(spark, [("Eggplant and coconuts",), ("veggie eggs, doughnuts and nuts",)], "s string", tg.matched_terms(F.col("s"), av.ALLERGEN_TERMS, av.ALLERGEN_FALSE_FRIENDS))
    assert terms == [[], ["egg", "nuts"]]


def test_name_split_and_prices(spark):
    got = values(spark, [("Miso Soup - with tofu",), ("Fish and Chips with peas and lemon",), ("grilled half chicken with rice and beans today",), ("Toast",)], "s string",
                 t.split_name_description(F.col("s")))
    assert [tuple(g) for g in got] == [("Miso Soup", "with tofu"), ("Fish and Chips", "with peas and lemon"), ("grilled half chicken with", "rice and beans today"), ("Toast", "")]
    prices = values(spark, [("Soup 12",), ("Steak 250 g 24",), ("Open 11 am",), ("section 12",), ("Toast 5.5 and jam 180",), ("Jam 180, toast 5.5",), ("Pad $14 for 2",)], "s string", t.line_prices(F.col("s"), True))
    # A number followed by a word is a quantity, one above 175 is no price.
    assert prices == [["12"], ["24"], [], [], [], ["5.5"], ["$14"]]


def test_recency_and_trust(spark):
    cases = [("https://a.com/wp-content/uploads/2024/05/menu.pdf", 2024 + 5 / 12), ("https://a.com/menu-2021-2022.pdf", 2022.0), ("https://a.com/menu_020422.pdf", 2022 + 2 / 12),
             ("https://a.com/m-20240317.pdf", 2024 + 3 / 12), ("https://a.com/menu", 0.0), ("https://a.com/x?v=2030", 0.0)]
    got = values(spark, [(c[0],) for c in cases], "s string", u.source_recency(F.col("s")))
    assert got == pytest.approx([c[1] for c in cases])
    trust = values(spark, [("https://www.acme.com/2025/a",), ("https://blog.net/2012/a",), ("",)], "s string", u.source_trust(F.col("s"), F.lit("acme.com"), 2026))
    assert trust == pytest.approx([1.0, 0.35, 0.85])


def test_resolve_and_regions_of_pages(spark):
    hrefs = [("/m", "https://a.com/m"), ("m", "https://a.com/x/m"), ("../m", "https://a.com/m"), ("?q", "https://a.com/x/y?q"), ("//b.com/z", "https://b.com/z"), ("./m", "https://a.com/x/m")]
    got = values(spark, [(h[0],) for h in hrefs], "s string", u.resolve_url(F.lit("https://a.com/x/y?z=1"), F.col("s")))
    assert got == [h[1] for h in hrefs]
    pages = [("https://x.co.nz/a", "hi", "NZ"), ("https://x.com", "see foo.de and bar.fr", None), ("https://x.com", "see foo.de and foo.de bar.fr", "DE"), ("https://x.com", "A New Zealand wine", None),
             ("https://x.com", "New Zealand NZ$ 4", "NZ"), ("https://x.com", "<html><style>p.no{}</style><p>order.php</p>", None)]
    got = values(spark, [p[:2] for p in pages], "u string, h string", x.detect_source_region(F.col("h"), F.col("u")))
    assert got == [p[2] for p in pages]


def test_grounding(spark):
    items = spark.createDataFrame([("s", "Rice", ""), ("s", "Cicero's Special (Small)", ""), ("s", "Fake Dish", "Cicero's Special"), ("s", "Price", ""), ("t", "Anything", "")],
                                  "source_url string, item_name string, quote string")
    sources = spark.createDataFrame([("s", "Cicero's Special price list"), ("t", " ")], "source_url string, text string")
    kept = {r.item_name: r.kept for r in ev.ground_names(items, sources).collect()}
    assert kept == {"Rice": False, "Cicero's Special (Small)": True, "Fake Dish": False, "Price": True, "Anything": True}


def test_union_keeps_every_allergen(spark):
    rows = [("r", "Pad Thai", [], "gemini", 0.9, "$9", 0), ("r", " pad  thai ", ["peanut"], "allergen_matrix", 0.5, "", 1), ("r", "Pad Thai", ["egg"], "gemini", 0.6, "$8", 2)]
    df = spark.createDataFrame(rows, "restaurant_id string, item_name string, allergen_terms array<string>, extraction_method string, confidence double, price string, arrival int")
    for order in (rows, rows[::-1]):
        out = ev.dedupe_items_across_sources(spark.createDataFrame(order, df.schema), arrays=("allergen_terms",)).collect()
        assert len(out) == 1 and out[0].allergen_terms == ["egg", "peanut"] and out[0].arrival == 1


def test_cuisines(spark):
    cases = [(["cuisine:thai;indian"], "x", ["thai", "indian"]), (["primary_type:italian_restaurant"], "x", ["italian"]), (["catering.restaurant.mexican"], "x", ["mexican"]),
             (["restaurant"], "Golden Pho House", ["vietnamese"]), ([], "Café Noir", ["cafe"]), (None, "Phoenix", [])]
    got = values(spark, [c[:2] for c in cases], "c array<string>, n string", e.cuisines_for(F.col("c"), F.col("n")))
    assert got == [c[2] for c in cases]


def test_provider_dumps(spark, tmp_path):
    osm = {"elements": [{"type": "node", "id": 1, "lat": 37.0, "lon": -122.0, "tags": {"name": "A", "amenity": "cafe", "addr:city": "Town", "website": "https://a.com"}},
                        {"type": "way", "id": 2, "center": {"lat": 37.1, "lon": -122.1}, "tags": {"name": "B", "disused:amenity": "pub"}}, {"type": "node", "id": 3, "tags": {"name": "C"}}]}
    (tmp_path / "osm.json").write_text(json.dumps(osm))
    rows = {r.source_id: r for r in sp.read_places_osm(spark, str(tmp_path / "osm.json"), (37.0, -122.0)).collect()}
    assert set(rows) == {"node/1", "way/2"} and rows["node/1"].business_status == "presumed_operational" and rows["node/1"].address == "Town"
    assert rows["way/2"].business_status == "closed_or_inactive" and rows["node/1"].distance_meters == 0.0 and rows["node/1"].data_quality_score == 0.571
    geo = {"features": [{"geometry": {"coordinates": [-122.0, 37.0]}, "properties": {"name": "G", "categories": ["catering"], "contact": {"phone": "1"}, "datasource": {"raw": {
        "takeaway": "yes", "delivery": "no", "outdoor_seating": "maybe", "osm_id": "9", "osm_type": "node"}}}}, {"geometry": {"coordinates": []}, "properties": {}}]}
    (tmp_path / "geo.json").write_text(json.dumps(geo))
    g = sp.read_places_geoapify(spark, str(tmp_path / "geo.json")).collect()
    assert len(g) == 1 and g[0].service_options == {"takeout": True, "delivery": False} and g[0].source_id == "node/9" and g[0].phone_number == "1"
    goo = {"places": [{"id": "p", "displayName": {"text": "N"}, "location": {"latitude": 1.0, "longitude": 2.0}, "primaryType": "cafe", "types": ["food"], "regularOpeningHours": {
        "weekdayDescriptions": ["Mon", "Tue"], "openNow": True}, "dineIn": False}]}
    (tmp_path / "goo.json").write_text(json.dumps(goo))
    p = sp.read_places_google(spark, str(tmp_path / "goo.json")).first()
    assert p.categories == ["primary_type:cafe", "food"] and p.opening_hours == "Mon; Tue" and p.is_open_now and p.service_options == {"dineIn": False}
    assert sp.union_providers(*(f for f in (sp.read_places_geoapify(spark, str(tmp_path / "geo.json")), sp.read_places_google(spark, str(tmp_path / "goo.json"))))).count() == 2


def test_csv_round_trip(spark, tmp_path):
    (tmp_path / "in.csv").write_bytes("﻿name,rating,review_count,categories,extra\nA,4.5,12.0,\"x; y\",z\nB,bad,,;,\n".encode())
    df = rec.read_records_csv(spark, str(tmp_path / "in.csv"), "name STRING, rating DOUBLE, review_count INT, categories ARRAY<STRING>, price STRING")
    assert [tuple(r) for r in df.collect()] == [("A", 4.5, 12, ["x", "y"], None), ("B", None, None, [], None)]
    out = rec.run_path(str(tmp_path), "restaurants", "San José, CA", "2026_01_01")
    rec.write_records_csv(df, out, ["name", "categories"])
    assert out.endswith("restaurants_san_jos_ca_2026_01_01")
    assert {tuple(r) for r in spark.read.option("header", True).csv(out).collect()} == {("A", "x; y"), ("B", None)}
    rec.write_records_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_caches_knowledge_and_documents(spark, tmp_path):
    (tmp_path / "ns").mkdir()
    (tmp_path / "ns" / "good.json").write_text('{"at": 5, "items": []}')
    (tmp_path / "ns" / "list.json").write_text("[1]")
    (tmp_path / "ns" / "bad.json").write_text("{oops")
    entries, rejected = rec.load_keyed_cache_dir(spark, str(tmp_path))
    assert [(r.namespace, r.key) for r in entries.collect()] == [("ns", "good")] and rejected.count() == 2
    (tmp_path / "kb").mkdir()
    (tmp_path / "kb" / "milk.json").write_text('[["Alfredo", 0.95, "cream"], ["ghee", 0.9, "fat"]]')
    assert [(r.allergen, r.pattern, r.risk) for r in rec.load_dish_kb(spark, str(tmp_path / "kb")).orderBy("ord").collect()] == [("milk", "alfredo", 0.95), ("milk", "ghee", 0.9)]
    (tmp_path / "hits.json").write_text(json.dumps({"query": "q", "web": {"results": [{"title": " T ", "url": "https://a.com", "extra_snippets": [" s ", ""]}, {"title": "x", "url": "ftp://b"}]}}))
    hits = rec.read_search_results(spark, str(tmp_path / "hits.json")).collect()
    assert len(hits) == 1 and hits[0].extra_snippets == ["s"]
    menu = {"scenario": "s", "menuSources": [{"candidate_url": "u", "confidence": 0.9}], "menuText": [{"char_count": 3}], "menuItems": [{"item_name": "A", "allergen_terms": ["egg"]}]}
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "one.json").write_text(json.dumps(menu))
    (tmp_path / "m" / "two.json").write_text(json.dumps({"scenario": "t"}))
    tables = rec.read_fixture_tables(spark, str(tmp_path / "m"))
    assert tables["menu_items"].first().allergen_terms == ["egg"] and tables["rejects"].first().missing == ["menuSources", "menuText", "menuItems"]
    (tmp_path / "runs.jsonl").write_text(json.dumps({"chain": "c", "item_count": 3, "methods": {"a": 2}, "coverage": [{"found": True, "items": 3}]}))
    runs = rec.read_run_results(spark, str(tmp_path / "runs.jsonl"))
    assert rec.run_coverage(runs).first()["items"] == 3 and runs.first().methods == {"a": 2}


def test_grids_and_json_pages(spark):
    html = ("<table><tr><th>Dish</th><th>Peanut</th><th>Coconut</th><th>Milk</th><th>Egg</th></tr><tr><td>Satay</td><td class='contains'></td><td>x</td><td>-</td><td><svg></svg></td></tr>"
            "<tr><td>Rice</td><td>not contained</td><td></td><td style='background:#fff'></td><td style='background:red'></td></tr></table>")
    pages = spark.createDataFrame([(1, "https://a.com", html)], "page_id int, url string, html string")
    got = {r.item_name: (r.allergen_terms, r.matrix_allergen_columns) for r in x.allergen_grid_long(pages).collect()}
    assert got == {"Satay": (["egg", "peanut"], ["egg", "milk", "peanut"]), "Rice": (["egg"], ["egg", "milk", "peanut"])}
    blob = '<script>window.__NUXT__ = {"a":[{"name":"Soup","price":{"amount":1295}},{"name":"Tea","price":"3.50"},{"name":"/x","price":2}]};</script>'
    pages = spark.createDataFrame([(1, "https://a.com", blob)], "page_id int, url string, html string")
    assert {(r.item_name, r.price) for r in x.embedded_json_items(pages).collect()} == {("Soup", "$12.95"), ("Tea", "$3.50")}
