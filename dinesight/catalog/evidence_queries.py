"""Grounding, merging, caching and source ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from dinesight.catalog import query
from dinesight.catalog.source_queries import (
    BARE, CITY_FACTS, DUPLICATE_KEY, GRADE_SQL, RECENCY, SOURCE_TYPE, any_sql, domain_sql, ends_sql, host_country_sql, NETLOC)
from dinesight.catalog.tables import (
    DISHES_SQL, LINKS_SQL, PLACES_SQL, dishes, links, pick, pick_sql, places, sql_list, table, with_tables)
from dinesight.functions import urls as u
from dinesight.functions.literals import text_array
from dinesight.operators import caching as c
from dinesight.operators import evidence as ev
from dinesight.operators import sources as s
from dinesight.vocab import web

WS = r"[\t\n\x0B\f\r \x{85}\p{Z}]+"


def collapsed(expr: str) -> str:
    return f"lower(trim(regexp_replace({expr}, '{WS}', ' ', 'g')))"


def stripped(expr: str) -> str:
    return f"regexp_replace(lower({expr}), '{WS}', '', 'g')"


def first(inner: str, keys: str, order: str, n: int = 1, rank: str = "rn") -> str:
    """SQL of keep_first."""
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS {rank} FROM {inner}) WHERE {rank} <= {n})"


# --- Grounding: benchmark passages against documents -------------------------------
def _claims(spark, sf_dir):
    """Each document claims a name and quote built from its own or another text."""
    d = table(spark, sf_dir, "documents")
    words = F.split(F.trim("text"), r"\s+")
    name = F.when(F.col("doc_id") % 3 == 0, F.array_join(F.slice(words, 2, 2), " ")).when(
        F.col("doc_id") % 3 == 1, F.concat(F.array_join(F.slice(words, 1, 2), " "), F.lit(" (Small)"))).otherwise("Invented Dish Name")
    quote = F.when(F.col("doc_id") % 2 == 0, F.array_join(F.slice(words, 1, 6), " ")).otherwise("not in the source at all")
    return d.select(F.col("doc_id").alias("source_url"), name.alias("item_name"), quote.alias("quote"))


_W = "string_split_regex(trim(text), '\\s+')"
CLAIMS_SQL = (
    f"SELECT doc_id AS source_url, text, CASE WHEN doc_id % 3 = 0 THEN array_to_string({_W}[2:3], ' ') WHEN doc_id % 3 = 1 THEN array_to_string({_W}[1:2], ' ') || ' (Small)' "
    f"ELSE 'Invented Dish Name' END AS item_name, CASE WHEN doc_id % 2 = 0 THEN array_to_string({_W}[1:6], ' ') ELSE 'not in the source at all' END AS quote FROM documents")


def _trace(name: str) -> str:
    """Bounded containment by splitting the text at the needle."""
    pieces = f"string_split(src, {collapsed(name)})"
    bounded = (f"len(list_filter({pieces}, lambda p, i: i > 1 AND NOT regexp_matches({pieces}[i - 1], '[\\p{{L}}\\p{{N}}_\\p{{M}}]$') "
               f"AND NOT regexp_matches(p, '^[\\p{{L}}\\p{{N}}_\\p{{M}}]'))) > 0")
    return f"(({collapsed(name)} <> '' AND {bounded}) OR (length({stripped(name)}) >= 8 AND contains(replace(src, ' ', ''), {stripped(name)})))"


_BASE = "CASE WHEN item_name LIKE '% (Small)' THEN item_name[1:-9] ELSE item_name END"
_TOKENS = "list_filter(string_split_regex(lower(base), '[^a-z0-9]+'), lambda w: length(w) >= 4)"


@query("ground_names", "JN-13", with_tables(
    f"SELECT source_url, {_trace('item_name')} OR (base <> item_name AND {_trace('base')}) OR (len({_TOKENS}) > 0 AND "
    f"len(list_filter({_TOKENS}, lambda w: contains(lower(quote), w))) >= (len({_TOKENS}) + 1) // 2 AND {_trace('quote')}) AS kept "
    f"FROM (SELECT *, {collapsed('text')} AS src, {_BASE} AS base FROM claims)", claims=CLAIMS_SQL))
def ground_names(spark, sf_dir):
    sources = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_url"), "text")
    return ev.ground_names(_claims(spark, sf_dir), sources).select("source_url", "kept")


_FRAGMENTS = f"list_filter(list_transform(string_split(q, '...'), lambda p: {stripped('p')}), lambda p: length(p) >= 8)"


@query("ground_quotes", "JN-14", with_tables(
    "SELECT source_url, kind, CASE WHEN kind = 'item' AND (" + _trace("item_name") + ") THEN true WHEN len(fr) > 0 THEN len(list_filter(fr, "
    "lambda p: contains(replace(src, ' ', ''), p) OR (length(p) > 40 AND contains(replace(src, ' ', ''), p[1:40])))) > 0 "
    f"ELSE {stripped('q')} <> '' AND contains(replace(src, ' ', ''), {stripped('q')}) END AS kept FROM (SELECT *, {_FRAGMENTS} AS fr FROM (SELECT *, {collapsed('text')} AS src, "
    "CASE WHEN source_url % 5 = 0 THEN 'zzz ... ' || quote ELSE quote END AS q, CASE WHEN source_url % 2 = 0 THEN 'item' ELSE 'note' END AS kind FROM claims))", claims=CLAIMS_SQL))
def ground_quotes(spark, sf_dir):
    return _marked_quotes(spark, sf_dir).select("source_url", "kind", "kept")


def _marked_quotes(spark, sf_dir):
    sources = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_url"), "text")
    records = _claims(spark, sf_dir).withColumn("kind", F.when(F.col("source_url") % 2 == 0, "item").otherwise("note")).withColumn(
        "quote", F.when(F.col("source_url") % 5 == 0, F.concat(F.lit("zzz ... "), "quote")).otherwise(F.col("quote")))
    return ev.ground_quotes(records, sources, ["source_url"])


_STATEMENTS = ["our nut-free kitchen is safe", "we offer nut free options?", "No nuts in our kitchen", "nut-free option list"]


@query("ground_statements", "JN-15",
       "SELECT doc_id, array_to_string(st, '|') AS statements, doc_id % 2 = 0 AND len(list_filter(st, lambda s: (contains(regexp_replace(lower(s), '[^a-z0-9]+', '', 'g'), 'nutfree') "
       "OR contains(regexp_replace(lower(s), '[^a-z0-9]+', '', 'g'), 'nonuts')) AND NOT contains(lower(s), 'option'))) > 0 AS nut_free_claim FROM (SELECT doc_id, "
       f"list_filter({sql_list(_STATEMENTS)}, lambda s: NOT ends_with(s, '?') AND contains({stripped('body')}, {stripped('s')})) AS st "
       f"FROM (SELECT doc_id, text || ' ' || {pick_sql(_STATEMENTS, 'doc_id')} AS body FROM documents))")
def ground_statements(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    pages = d.select(F.col("doc_id").alias("url"), F.concat("text", F.lit(" "), pick(_STATEMENTS, F.col("doc_id"))).alias("text"))
    signals = d.select(F.col("doc_id").alias("url"), text_array(_STATEMENTS).alias("statements"), (F.col("doc_id") % 2 == 0).alias("nut_free_claim"))
    return ev.ground_statements(signals, pages).select(F.col("url").alias("doc_id"), F.array_join("statements", "|").alias("statements"), "nut_free_claim")


# --- Merging dishes --------------------------------------------------------------------
def joined_terms(df, *keys):
    return df.select(*keys, *[F.array_join(F.array_sort(a), ",").alias(a) for a in ev.TERM_ARRAYS])


def union_sql(keys: str, key_expr: str, order: str, source: str = "dishes", where: str = "true", arrays=ev.TERM_ARRAYS) -> str:
    """SQL of merge_records over dish rows: winner's arrival, union of arrays."""
    sets = ", ".join(f"coalesce(array_to_string(list_sort(list_distinct(flatten(list({a})))), ','), '') AS {a}" for a in arrays)
    return (f"SELECT {keys}, dish_key, arg_min(arrival, pos) AS arrival, {sets} FROM (SELECT *, row_number() OVER (PARTITION BY {keys}, dish_key ORDER BY {order}) AS pos "
            f"FROM (SELECT *, {key_expr} AS dish_key FROM {source}) WHERE dish_key <> '' AND {where}) GROUP BY {keys}, dish_key")


_RANK_SQL = ("CASE WHEN len(allergen_terms) > 0 THEN 1 ELSE 0 END DESC, CASE WHEN starts_with(extraction_method, 'gemini') THEN 0 ELSE 1 END DESC, "
             "confidence DESC, CASE WHEN trim(price) <> '' THEN 1 ELSE 0 END DESC, arrival")


@query("dedupe_items_across_sources", "WI-1", with_tables(union_sql("restaurant_id", collapsed("item_name"), _RANK_SQL), dishes=DISHES_SQL))
def dedupe_items_across_sources(spark, sf_dir):
    return joined_terms(ev.dedupe_items_across_sources(dishes(spark, sf_dir)), "restaurant_id", "dish_key", "arrival")


@query("fold_by_name", "WI-2", with_tables(union_sql("restaurant_id", "lower(item_name)", "arrival"), dishes=DISHES_SQL))
def fold_by_name(spark, sf_dir):
    return joined_terms(ev.fold_by_name(dishes(spark, sf_dir)), "restaurant_id", "dish_key", "arrival")


@query("ordered_distinct", "SE-2", with_tables(
    "SELECT restaurant_id, item_name, min(arrival) AS first_seen FROM dishes GROUP BY ALL", dishes=DISHES_SQL))
def ordered_distinct(spark, sf_dir):
    return dishes(spark, sf_dir).groupBy("restaurant_id", "item_name").agg(F.min("arrival").alias("first_seen"))


_NAME_KEY = "trim(regexp_replace(replace(lower(item_name), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"


@query("dedupe_items_csv", "WI-8", with_tables(
    f"SELECT restaurant_id, arrival FROM {first('(SELECT *, ' + _NAME_KEY + ' AS nk FROM dishes)', 'restaurant_id, nk, price', 'arrival')}", dishes=DISHES_SQL))
def dedupe_items_csv(spark, sf_dir):
    return ev.dedupe_items_csv(dishes(spark, sf_dir)).select("restaurant_id", "arrival")


@query("merge_chunks", "AG-16", with_tables(
    "SELECT m.*, c.incomplete FROM (" + union_sql("source_url", "lower(item_name)", "arrival", source="(SELECT *, menu_source_url AS source_url FROM dishes)")
    + ") m LEFT JOIN (SELECT menu_source_url AS source_url, bool_or(k % 13 = 0) AS incomplete FROM dishes GROUP BY 1) c USING (source_url)", dishes=DISHES_SQL))
def merge_chunks(spark, sf_dir):
    rows = dishes(spark, sf_dir).withColumnRenamed("menu_source_url", "source_url")
    chunks = rows.select("source_url", (F.col("k") % 13 == 0).alias("failed"))
    return joined_terms(ev.merge_chunks(rows, chunks), "source_url", "dish_key", "arrival", "incomplete")


_PRIMARY, _SECONDARY = "extraction_method = 'allergen_matrix'", "extraction_method = 'gemini_text'"


@query("union_evidence", "JN-17", with_tables(
    "SELECT p.restaurant_id, p.arrival, " + ", ".join(
        f"array_to_string(list_sort(list_distinct(CASE WHEN p.pos = 1 THEN list_concat(p.{a}, coalesce(x.{a}, [])) ELSE p.{a} END)), ',') AS {a}" for a in ev.TERM_ARRAYS)
    + f" FROM (SELECT *, {collapsed('item_name')} AS dk, row_number() OVER (PARTITION BY restaurant_id, {collapsed('item_name')} ORDER BY arrival) AS pos FROM dishes WHERE {_PRIMARY}) p "
    "LEFT JOIN sec x ON x.restaurant_id = p.restaurant_id AND x.dk = p.dk UNION ALL SELECT restaurant_id, arrival, "
    + ", ".join(f"array_to_string(list_sort({a}), ',')" for a in ev.TERM_ARRAYS)
    + f" FROM sec x WHERE NOT EXISTS (SELECT 1 FROM dishes p WHERE {_PRIMARY} AND p.restaurant_id = x.restaurant_id AND {collapsed('p.item_name')} = x.dk)",
    dishes=DISHES_SQL, sec=f"SELECT restaurant_id, {collapsed('item_name')} AS dk, min(arrival) AS arrival, "
    + ", ".join(f"list_distinct(flatten(list({a}))) AS {a}" for a in ev.TERM_ARRAYS) + f" FROM dishes WHERE {_SECONDARY} GROUP BY ALL"))
def union_evidence(spark, sf_dir):
    rows = dishes(spark, sf_dir)
    return joined_terms(ev.union_evidence(rows.where(_PRIMARY), rows.where(_SECONDARY)), "restaurant_id", "arrival")


def _components(spark, sf_dir):
    rows = dishes(spark, sf_dir)
    part = F.col("source_type") == "pdf"
    return rows.withColumn("is_component", part).withColumn(
        "parent_item", F.when(part, F.when(F.col("confidence") > 0.6, F.concat(F.upper("item_name"), F.lit("®"))).otherwise("No Such Dish")).otherwise(""))


_CARR = ("allergen_terms", "cross_contact_terms", "matrix_allergen_columns")


def _nk(expr: str) -> str:
    return f"regexp_replace(lower({expr}), '[^a-z0-9]+', '', 'g')"


@query("collapse_components", "JN-18", with_tables(
    "SELECT p.restaurant_id, p.arrival, " + ", ".join(f"array_to_string(list_sort(list_distinct(list_concat(p.{a}, coalesce(x.{a}, [])))), ',') AS {a}" for a in _CARR)
    + f" FROM items p LEFT JOIN comps x ON x.restaurant_id = p.restaurant_id AND x.dk = {_nk('p.item_name')} WHERE NOT p.is_component UNION ALL SELECT restaurant_id, arrival, "
    + ", ".join(f"array_to_string(list_sort({a}), ',')" for a in _CARR) + f" FROM items x WHERE x.is_component AND NOT EXISTS (SELECT 1 FROM items p WHERE NOT p.is_component "
    f"AND p.restaurant_id = x.restaurant_id AND {_nk('p.item_name')} = {_nk('x.parent_item')})",
    dishes=DISHES_SQL, items="SELECT *, source_type = 'pdf' AS is_component, CASE WHEN source_type = 'pdf' THEN CASE WHEN confidence > 0.6 THEN upper(item_name) || '®' ELSE 'No Such Dish' END ELSE '' END AS parent_item FROM dishes",
    comps=f"SELECT restaurant_id, {_nk('parent_item')} AS dk, " + ", ".join(f"list_distinct(flatten(list({a}))) AS {a}" for a in _CARR) + " FROM items WHERE is_component GROUP BY ALL"))
def collapse_components(spark, sf_dir):
    rows = ev.collapse_components(_components(spark, sf_dir))
    return rows.select("restaurant_id", "arrival", *[F.array_join(F.array_sort(a), ",").alias(a) for a in _CARR])


@query("net_new_gate", "JN-29", with_tables(
    "SELECT arrival, 'chart' AS origin FROM dishes WHERE " + _PRIMARY + " UNION ALL SELECT t.arrival, 'text' FROM dishes t LEFT JOIN gate g ON g.restaurant_id = t.restaurant_id "
    f"WHERE t.{_SECONDARY} AND (g.restaurant_id IS NULL OR g.n_new > g.n_chart)", dishes=DISHES_SQL,
    gate=f"SELECT c.restaurant_id, c.n_chart, coalesce(n.n_new, 0) AS n_new FROM (SELECT restaurant_id, count(*) AS n_chart FROM dishes WHERE {_PRIMARY} GROUP BY 1) c LEFT JOIN "
    f"(SELECT restaurant_id, count(*) AS n_new FROM dishes t WHERE {_SECONDARY} AND NOT EXISTS (SELECT 1 FROM dishes p WHERE p.{_PRIMARY} AND p.restaurant_id = t.restaurant_id "
    f"AND {_nk('p.item_name')} = {_nk('t.item_name')}) GROUP BY 1) n USING (restaurant_id)"))
def net_new_gate(spark, sf_dir):
    rows = dishes(spark, sf_dir)
    return ev.net_new_gate(rows.where(_PRIMARY), rows.where(_SECONDARY), source="restaurant_id").select("arrival", "origin")


_PARSERS = {"allergen_matrix": 1, "schema_org_menu_item": 2, "html_visible_text": 3, "community_mention": 4}
_PARSER_CASE = "CASE extraction_method " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _PARSERS.items()) + " ELSE 1000 END"


@query("interpret_by_precedence", "TX-17", with_tables(
    f"SELECT arrival FROM (SELECT *, {_PARSER_CASE} AS r, min({_PARSER_CASE}) OVER (PARTITION BY menu_source_url) AS best FROM dishes) WHERE r = best", dishes=DISHES_SQL))
def interpret_by_precedence(spark, sf_dir):
    from dinesight.functions.literals import lookup
    method = F.col("extraction_method")
    rows = dishes(spark, sf_dir).withColumnRenamed("menu_source_url", "source_url").withColumn(
        "parser", F.when(method == "gemini_text", "llm_text").otherwise(method)).withColumn("parser_rank", lookup(method, _PARSERS))
    return ev.interpret_by_precedence(rows).select("arrival")


_CHART_HEADS = [["Milk", "Tree Nuts"], ["Peanuts", "Coconut", "Soja"]]


@query("absorb_matrix_rows", "TX-11", with_tables(
    "SELECT source_url, arrival AS row_ord, item_name, array_to_string(allergen_terms, ',') AS allergen_terms, CASE WHEN k % 2 = 0 THEN 'milk,tree nut' ELSE 'peanut,soy' END AS matrix_columns, "
    "CASE WHEN len(allergen_terms) > 0 THEN item_name || ' contains ' || array_to_string(allergen_terms, ', ') ELSE item_name END AS raw_text "
    f"FROM {first('(SELECT *, menu_source_url || CAST(k AS VARCHAR) AS source_url, lower(trim(item_name)) AS dk FROM dishes)', 'source_url, dk', 'arrival')}", dishes=DISHES_SQL))
def absorb_matrix_rows(spark, sf_dir):
    heads = F.when(F.col("k") % 2 == 0, text_array(_CHART_HEADS[0])).otherwise(text_array(_CHART_HEADS[1]))
    rows = dishes(spark, sf_dir).select(
        F.concat("menu_source_url", F.col("k").cast("string")).alias("source_url"), F.col("arrival").alias("row_ord"), F.col("item_name").alias("dish"),
        F.col("allergen_terms").alias("allergens"), F.col("cross_contact_terms").alias("cross_contact"), heads.alias("columns"),
        F.lit(False).alias("is_component"), F.lit("").alias("of_dish"))
    return ev.absorb_matrix_rows(rows).select("source_url", "row_ord", "item_name", F.array_join("allergen_terms", ",").alias("allergen_terms"),
                                              F.array_join("matrix_allergen_columns", ",").alias("matrix_columns"), "raw_text")


def _nested(spark, sf_dir):
    """Order documents: line items as extracted dishes, priorities as notes."""
    from dinesight.schemas import EVIDENCE
    rows = table(spark, sf_dir, "orders").select(F.to_json(F.struct(
        F.col("o_orderkey").cast("string").alias("restaurant_name"),
        F.array(F.struct(F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("candidate_id"), F.col("o_orderpriority").alias("item_name"),
                         F.split("o_orderpriority", "-").alias("dietary_tags"), F.lit(0.5).alias("confidence"))).alias("menu_items"),
        F.array(F.struct(F.col("o_orderstatus").alias("note_type"), F.array("o_orderstatus", F.lit("all")).alias("applies_to"))).alias("restaurant_notes"))).alias("doc"))
    return rows.select(F.from_json("doc", EVIDENCE).alias("d")).select("d.*")


@query("flatten_evidence_items", "SC-13",
       "SELECT CAST(o_orderkey AS VARCHAR) AS restaurant_name, 'c' || CAST(o_orderkey AS VARCHAR) AS candidate_id, o_orderpriority AS item_name, replace(o_orderpriority, '-', '; ') AS dietary_tags FROM orders")
def flatten_evidence_items(spark, sf_dir):
    return ev.flatten_evidence(_nested(spark, sf_dir))[0].select("restaurant_name", "candidate_id", "item_name", "dietary_tags")


@query("flatten_evidence_notes", "SC-13",
       "SELECT CAST(o_orderkey AS VARCHAR) AS restaurant_name, o_orderstatus AS note_type, o_orderstatus || '; all' AS applies_to FROM orders")
def flatten_evidence_notes(spark, sf_dir):
    return ev.flatten_evidence(_nested(spark, sf_dir))[1].select("restaurant_name", "note_type", "applies_to")


# --- Community and signals ----------------------------------------------------------------
_KINDS = ["adverse_event", "good_handling", "none", "poor_handling", "allergen_presence"]
_MENTIONS = ["peanut butter", "Almond flour", "nuts", "Sesame", ""]


def parsed_reviews(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    k = F.col("conv_id") * 3 + F.col("turn")
    quote = F.when(k % 4 == 0, "made up quote").otherwise(F.array_join(F.slice(F.split(F.trim("text"), r"\s+"), 1, 4), " "))
    return t.select(F.col("conv_id").alias("restaurant_id"), "turn", pick(_KINDS, k).alias("type"), pick(_MENTIONS, k * 2).alias("allergen"),
                    quote.alias("quote"), F.col("text").alias("bundle"), (k * 50 % 1000).alias("age_days"))


_ALLERGEN_SQL = "CASE WHEN a = '' THEN NULL WHEN contains(a, 'peanut') THEN 'peanuts' WHEN contains(a, 'almond') THEN 'tree_nuts' WHEN contains(a, 'nut') THEN 'nuts' ELSE a END"
REVIEWS_SQL = (
    f"SELECT conv_id AS restaurant_id, turn, {pick_sql(_KINDS, 'k')} AS type, {pick_sql(_MENTIONS, 'k * 2')} AS allergen, CASE WHEN k % 4 = 0 THEN 'made up quote' "
    "ELSE array_to_string(string_split_regex(trim(text), '\\s+')[1:4], ' ') END AS quote, text AS bundle, k * 50 % 1000 AS age_days FROM (SELECT *, conv_id * 3 + turn AS k FROM conversations)")


@query("community_signals", "TX-23", with_tables(
    f"SELECT restaurant_id, turn, type, {_ALLERGEN_SQL} AS allergen, quote[1:240] AS quote FROM (SELECT *, lower(allergen) AS a FROM reviews) WHERE type <> 'none' AND quote <> '' AND contains({collapsed('bundle')}, {collapsed('quote')})",
    reviews=REVIEWS_SQL))
def community_signals(spark, sf_dir):
    rows = parsed_reviews(spark, sf_dir).withColumn("restaurant_id", F.concat_ws("-", "restaurant_id", "turn"))
    found = ev.community_signals(rows.drop("bundle"), rows.select("restaurant_id", "bundle"))
    return found.select(F.split("restaurant_id", "-")[0].cast("bigint").alias("restaurant_id"), "turn", "type", "allergen", "quote")


_DIETS = ["Vegan", "vegetarian ", "keto", "", "vegan"]


@query("community_diets", "TX-23", with_tables(
    f"SELECT restaurant_id, turn, lower(trim(diet)) AS diet, quote[1:240] AS quote, 'https://r.test/' || restaurant_id AS url, 'community' AS source FROM (SELECT *, {pick_sql(_DIETS, 'restaurant_id + turn')} AS diet FROM reviews) "
    f"WHERE lower(trim(diet)) IN ('vegan', 'vegetarian') AND quote <> '' AND contains({collapsed('bundle')}, {collapsed('quote')})", reviews=REVIEWS_SQL))
def community_diets(spark, sf_dir):
    rows = parsed_reviews(spark, sf_dir).withColumns({
        "diet": pick(_DIETS, F.col("restaurant_id") + F.col("turn")), "url": F.concat(F.lit("https://r.test/"), F.col("restaurant_id").cast("string")),
        "restaurant_id": F.concat_ws("-", "restaurant_id", "turn")})
    found = ev.community_diets(rows.select("restaurant_id", "turn", "diet", "quote"), rows.select("restaurant_id", "bundle", "url"))
    return found.select(F.split("restaurant_id", "-")[0].cast("bigint").alias("restaurant_id"), "turn", "diet", "quote", "url", "source")


@query("community_dishes", "TX-23",
       "SELECT restaurant_id, item_name FROM (SELECT conv_id AS restaurant_id, trim(w) AS item_name, row_number() OVER (PARTITION BY conv_id, lower(trim(w)) ORDER BY turn, w) AS rn "
       "FROM (SELECT conv_id, turn, unnest(string_split(text, '.')) AS w FROM conversations) WHERE length(trim(w)) BETWEEN 1 AND 80) WHERE rn = 1")
def community_dishes(spark, sf_dir):
    mentions = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("restaurant_id"), "turn", F.explode(F.split("text", r"\.")).alias("dish")).withColumn("mention_ord", F.struct("turn", "dish"))
    return ev.community_dishes(mentions).select("restaurant_id", "item_name")


@query("non_community_items", "FI-12", with_tables("SELECT arrival FROM dishes WHERE source_type <> 'community'", dishes=DISHES_SQL))
def non_community_items(spark, sf_dir):
    return ev.non_community_items(dishes(spark, sf_dir)).select("arrival")


_PHRASES = ["Food allergy notice posted", "Shared-fryer in use", "please inform staff", "a tree-nut-free menu", "may contain traces", "lovely soup"]


def _has_any(words: list[str]) -> str:
    return any_sql("low", words)


@query("restaurant_signals", "TX-19", with_tables(
    "SELECT restaurant_id, bool_or(" + _has_any(web.DISCLAIMER_WORDS) + ") AS has_allergy_disclaimer, bool_or(" + _has_any(web.CROSS_CONTACT_WORDS) + ") AS has_cross_contact_warning, bool_or("
    + _has_any(web.STAFF_WORDS) + ") AS mentions_staff_allergy_instruction, bool_or(" + _has_any(web.NUT_FREE_WORDS) + ") AS has_nut_free_claim FROM (SELECT restaurant_id, "
    f"replace(lower(item_name || ' ' || description || ' ' || price || ' ' || array_to_string(dietary_terms, ' ') || ' ' || array_to_string(allergen_terms, ' ')), '-', ' ') AS low FROM dishes "
    f"UNION ALL SELECT 's' || CAST(doc_id % 100 AS VARCHAR), replace(lower(text || ' ' || {pick_sql(_PHRASES, 'doc_id')}), '-', ' ') FROM documents) GROUP BY 1", dishes=DISHES_SQL))
def restaurant_signals(spark, sf_dir):
    empty = F.expr("CAST(array() AS ARRAY<STRING>)")
    texts = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("s"), (F.col("doc_id") % 100).cast("string")).alias("restaurant_id"),
        F.concat("text", F.lit(" "), pick(_PHRASES, F.col("doc_id"))).alias("extracted_text"), empty.alias("dietary_terms"), empty.alias("allergen_terms"))
    return ev.restaurant_signals(texts, dishes(spark, sf_dir).withColumn("raw_text", F.lit("")))


_FLAGS = ["allergy_friendly_claim", "cross_contact_warning", "ask_staff", "allergen_menu_available", "nut_free_claim"]


def page_flags(spark, sf_dir):
    i = F.col("page_id")
    flags = [((i % (n + 3)) == 0).alias(name) for n, name in enumerate(_FLAGS)]
    return table(spark, sf_dir, "pages").select((i % 30).alias("restaurant_id"), i.alias("page_ord"), *flags,
                                                F.array(pick(_PHRASES, i % 4), pick(_PHRASES, i % 3)).alias("statements"), ((i * 7 % 10) / 10.0).alias("evidence_confidence"))


FLAGS_SQL = ("SELECT page_id % 30 AS restaurant_id, page_id AS page_ord, " + ", ".join(f"page_id % {n + 3} = 0 AS {name}" for n, name in enumerate(_FLAGS))
             + f", [{pick_sql(_PHRASES, 'page_id % 4')}, {pick_sql(_PHRASES, 'page_id % 3')}] AS statements, (page_id * 7 % 10) / CAST(10 AS DOUBLE) AS evidence_confidence FROM pages")


@query("signals_rollup", "AG-36", with_tables(
    "SELECT restaurant_id, bool_or(nut_free_claim) AS nut_free_claim, bool_or(cross_contact_warning) AS cross_contact_warning, bool_or(ask_staff) AS ask_staff, "
    "bool_or(allergen_menu_available) AS allergen_menu_available, bool_or(allergy_friendly_claim) AS allergy_disclaimer FROM flags GROUP BY 1", flags=FLAGS_SQL))
def signals_rollup(spark, sf_dir):
    return ev.signals_rollup(page_flags(spark, sf_dir))


@query("merge_restaurant_signals", "AG-15", with_tables(
    "SELECT restaurant_id, " + ", ".join(f"bool_or({f}) AS {f}" for f in _FLAGS) + ", max(evidence_confidence) AS evidence_confidence FROM flags GROUP BY 1", flags=FLAGS_SQL))
def merge_restaurant_signals(spark, sf_dir):
    return ev.merge_restaurant_signals(page_flags(spark, sf_dir), _FLAGS)


@query("merge_notes", "AG-15", with_tables(
    "SELECT restaurant_id, note_text, page_ord AS note_ord FROM " + first("(SELECT *, statements[1] AS note_text FROM flags)", "restaurant_id, note_text", "page_ord DESC"), flags=FLAGS_SQL))
def merge_notes(spark, sf_dir):
    notes = page_flags(spark, sf_dir).select("restaurant_id", F.lit("policy").alias("note_type"), F.get("statements", F.lit(0)).alias("note_text"),
                                             F.lit("u").alias("source_url"), F.col("page_ord").alias("note_ord"))
    return ev.merge_notes(notes).select("restaurant_id", "note_text", "note_ord")


@query("signal_dedupe", "AG-18", with_tables(
    "SELECT restaurant_id, page_ord FROM " + first("(SELECT *, array_to_string(list_sort(statements), '|') AS st FROM flags)", "restaurant_id, " + ", ".join(_FLAGS) + ", st", "page_ord"), flags=FLAGS_SQL))
def signal_dedupe(spark, sf_dir):
    return ev.signal_dedupe(page_flags(spark, sf_dir), _FLAGS, "page_ord").select("restaurant_id", "page_ord")


@query("source_report", "AG-17", with_tables(
    "SELECT p.source_url, coalesce(i.n, 0) > 0 AS found, coalesce(i.n, 0) AS item_count, coalesce(i.c, 0) AS confidence FROM (SELECT DISTINCT 'https://' || h || '/' || y AS source_url FROM "
    f"(SELECT unnest({sql_list(['www.goldendiner.com', 'bluegarden.co.uk', 'nowhere.com'])}) AS h), (SELECT unnest(['2024', '2019', 'menu']) AS y)) p LEFT JOIN "
    "(SELECT menu_source_url AS source_url, count(*) AS n, round(avg(confidence), 3) AS c FROM dishes GROUP BY 1) i USING (source_url)", dishes=DISHES_SQL))
def source_report(spark, sf_dir):
    hosts, years = text_array(["www.goldendiner.com", "bluegarden.co.uk", "nowhere.com"]), text_array(["2024", "2019", "menu"])
    payloads = spark.range(1).select(F.explode(hosts).alias("h")).select("h", F.explode(years).alias("y")).select(
        F.concat(F.lit("https://"), "h", F.lit("/"), "y").alias("source_url"))
    items = dishes(spark, sf_dir).select(F.col("menu_source_url").alias("source_url"), "confidence", F.col("extraction_method").alias("parser"))
    return ev.source_report(payloads, items).select("source_url", "found", "item_count", "confidence")


@query("group_sources", "AG-33", with_tables(
    "SELECT restaurant_id AS restaurant_source_id, item_name AS restaurant_name, count(*) AS n_rows, min(arrival) AS first_row FROM dishes WHERE trim(item_name) <> '' GROUP BY ALL", dishes=DISHES_SQL))
def group_sources(spark, sf_dir):
    rows = dishes(spark, sf_dir).select(F.col("restaurant_id").alias("restaurant_source_id"), F.col("item_name").alias("restaurant_name"),
                                        F.col("arrival").alias("row_ord"), F.col("description").alias("extracted_text"))
    return ev.group_sources(rows).select("restaurant_source_id", "restaurant_name", "n_rows", "first_row")


@query("candidate_ids", "PR-34", with_tables(
    "SELECT restaurant_id, arrival, printf('c%04d', rn) AS candidate_id FROM (SELECT *, row_number() OVER (PARTITION BY restaurant_id ORDER BY arrival) AS rn FROM dishes)", dishes=DISHES_SQL))
def candidate_ids(spark, sf_dir):
    return ev.candidate_ids(dishes(spark, sf_dir)).select("restaurant_id", "arrival", "candidate_id")


@query("candidate_validation_summary", "AG-34", with_tables(
    "SELECT restaurant_id, count(*) AS candidate_rows, count(v) AS validated_rows, count(*) FILTER (v) AS accepted_rows, count(*) FILTER (NOT v) AS rejected_rows, "
    "count(*) FILTER (v IS NULL) AS missing_rows FROM (SELECT restaurant_id, CASE WHEN rn % 7 <> 0 THEN rn % 3 <> 0 END AS v FROM (SELECT *, row_number() OVER (PARTITION BY restaurant_id ORDER BY arrival) AS rn FROM dishes)) GROUP BY 1", dishes=DISHES_SQL))
def candidate_validation_summary(spark, sf_dir):
    candidates = ev.candidate_ids(dishes(spark, sf_dir)).select("restaurant_id", "candidate_id")
    n = F.substring("candidate_id", 2, 10).cast("int")
    verdicts = candidates.where(n % 7 != 0).select("restaurant_id", "candidate_id", (n % 3 != 0).alias("is_menu_item"))
    return ev.candidate_validation_summary(candidates, verdicts)


# --- Ranking sources ---------------------------------------------------------------------
def kinded(spark, sf_dir):
    return s.classify_links(links(spark, sf_dir))


_RAW = "lower(url || ' ' || anchor)"
_KIND = "CASE " + " ".join(f"WHEN len(list_filter({sql_list(tokens)}, lambda v: contains(raw, v) OR contains(folded, v))) > 0 THEN '{kind}'" for kind, tokens in web.LINK_KINDS) + " END"
KINDED_SQL = f"SELECT * FROM (SELECT *, {_KIND} AS kind FROM (SELECT *, {_RAW} AS raw, strip_accents({_RAW}) AS folded FROM links)) WHERE kind IS NOT NULL"
_PRIO = "CASE kind WHEN 'allergen' THEN 0 WHEN 'allergy_info' THEN 1 WHEN 'nutrition' THEN 2 ELSE 3 END"
_CANONICAL = "regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '')"


@query("classify_links", "TX-20", with_tables("SELECT link_id, kind FROM kinded", links=LINKS_SQL, kinded=KINDED_SQL))
def classify_links(spark, sf_dir):
    return kinded(spark, sf_dir).select("link_id", "kind")


@query("dedupe_sources", "WI-3", with_tables(
    "SELECT restaurant_id, link_id FROM " + first(f"(SELECT *, {_CANONICAL} AS cu FROM links)", "restaurant_id, cu", "confidence DESC, link_id"), links=LINKS_SQL))
def dedupe_sources(spark, sf_dir):
    return s.dedupe_sources(links(spark, sf_dir), "link_id").select("restaurant_id", "link_id")


@query("sources_by_confidence", "SO-3", with_tables(
    "SELECT restaurant_id, link_id, CAST(position AS INTEGER) AS position FROM " + first("links", "restaurant_id", "confidence DESC, link_id", 25, "position"), links=LINKS_SQL))
def sources_by_confidence(spark, sf_dir):
    return s.sources_by_confidence(links(spark, sf_dir), "link_id").select("restaurant_id", "link_id", "position")


def _dated(source: str) -> str:
    return (f"(SELECT *, {RECENCY} AS rec, CASE WHEN ends_with(b, '.pdf') AND {RECENCY} > 0 THEN {DUPLICATE_KEY} ELSE 'row:' || CAST(link_id AS VARCHAR) END AS dk "
            f"FROM (SELECT *, {BARE.format('url')} AS b FROM {source}))")


@query("collapse_dated_reuploads", "WI-4", with_tables(
    "SELECT restaurant_id, link_id FROM " + first(_dated("links"), "restaurant_id, dk", "rec DESC, link_id"), links=LINKS_SQL))
def collapse_dated_reuploads(spark, sf_dir):
    return s.collapse_dated_reuploads(links(spark, sf_dir), "link_id").select("restaurant_id", "link_id")


FINAL_SQL = ("SELECT restaurant_id, link_id, url, kind, position FROM " + first(
    first(_dated(first(f"(SELECT *, {_PRIO} AS prio FROM kinded)", "restaurant_id, url", "prio, link_id")), "restaurant_id, dk", "rec DESC, link_id", rank="rn2"),
    "restaurant_id", "prio, CASE WHEN ends_with(b, '.pdf') THEN 0 ELSE 1 END, rec DESC, link_id", 12, "position"))


@query("finalize_candidates", "WI-5", with_tables("SELECT restaurant_id, link_id, CAST(position AS INTEGER) AS position FROM final", links=LINKS_SQL, kinded=KINDED_SQL, final=FINAL_SQL))
def finalize_candidates(spark, sf_dir):
    return s.finalize_candidates(kinded(spark, sf_dir), "link_id").select("restaurant_id", "link_id", "position")


_OFFICIAL = "CASE WHEN CAST(substr(restaurant_id, 2) AS INTEGER) % 2 = 0 THEN 'goldendiner.com' ELSE 'thaihouse.de' END"
_PROV = ("CASE WHEN dom = off THEN 0 WHEN cc = home THEN 1 WHEN cc <> home THEN 3 ELSE 2 END")
PROV_LINKS = f"(SELECT *, {_PROV} AS prov, {RECENCY} AS rec FROM (SELECT *, {_OFFICIAL} AS off, {BARE.format('url')} AS b, {host_country_sql(NETLOC.format('url'))} AS cc, {domain_sql('url')} AS dom FROM links))"


def _with_official(df):
    even = F.substring("restaurant_id", 2, 10).cast("int") % 2 == 0
    return df.withColumn("official_domain", F.when(even, "goldendiner.com").otherwise("thaihouse.de"))


@query("rank_sources", "WI-6", with_tables(
    "SELECT restaurant_id, link_id, CAST(position AS INTEGER) AS position FROM " + first(PROV_LINKS, "restaurant_id", "prov, rec DESC, link_id", 8, "position"), links=LINKS_SQL))
def rank_sources(spark, sf_dir):
    return s.rank_sources(_with_official(links(spark, sf_dir)), "link_id", 8).select("restaurant_id", "link_id", "position")


@query("web_candidates", "WI-18", with_tables(
    "SELECT restaurant_id, link_id, CAST(position AS INTEGER) AS position FROM " + first(first(
        f"(SELECT * FROM {PROV_LINKS} WHERE ends_with(b, '.pdf') OR contains({_RAW}, 'allerg') OR contains({_RAW}, 'nutrition'))", "restaurant_id, url", "link_id"),
        "restaurant_id", "prov, rec DESC, link_id", 8, "position"), links=LINKS_SQL))
def web_candidates(spark, sf_dir):
    hits = _with_official(links(spark, sf_dir)).withColumnRenamed("anchor", "title").withColumn(
        "query_ord", F.floor(F.col("link_id") / 1000)).withColumn("result_ord", F.col("link_id") % 1000)
    return s.web_candidates(hits).select("restaurant_id", "link_id", "position")


@query("best_source_per_restaurant", "WI-7", with_tables(
    "SELECT restaurant_id, link_id FROM " + first(
        "(SELECT *, CASE " + GRADE_SQL.format(s="validation_status", t="st", c="confidence").replace("CASE WHEN", "WHEN", 1).replace("THEN 'A'", "THEN 5").replace("THEN 'B'", "THEN 4")
        .replace("THEN 'C'", "THEN 3").replace("ELSE 'D'", "ELSE 2").replace("THEN 'F'", "THEN 1") + f" AS g FROM (SELECT *, {SOURCE_TYPE} AS st FROM links))",
        "restaurant_id", "g DESC, CASE validation_status WHEN 'validated' THEN 3 WHEN 'unvalidated' THEN 2 WHEN 'not_fetchable' THEN 1 ELSE 0 END DESC, confidence DESC, "
        "CASE st WHEN 'pdf' THEN 5 WHEN 'nutrition_or_allergen_page' THEN 4 WHEN 'website_link' THEN 3 WHEN 'ordering_page' THEN 2 ELSE 1 END DESC, link_id"), links=LINKS_SQL))
def best_source_per_restaurant(spark, sf_dir):
    return s.best_source_per_restaurant(typed_links(spark, sf_dir), "link_id").select("restaurant_id", "link_id")


def typed_links(spark, sf_dir):
    kind = u.source_type(F.col("url"), F.col("anchor"))
    rows = links(spark, sf_dir).withColumn("source_type", kind).withColumn("is_primary", u.is_primary_candidate(F.col("url"), F.col("anchor")))
    return rows.withColumn("evidence_grade", u.evidence_grade(F.col("confidence"), F.col("validation_status"), F.col("source_type")))


_SIGNAL_SQL = f"lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1) || ' ' || regexp_extract(url, '^[^?#]*[?]([^#]*)', 1) || ' ' || anchor)"


@query("filter_validated_sources", "FI-8", with_tables(
    f"SELECT link_id FROM (SELECT *, {SOURCE_TYPE} AS st FROM links) WHERE CASE WHEN st = 'ordering_page' THEN true WHEN st = 'image' THEN false ELSE validation_status = 'validated' AND "
    f"(st IN ('pdf', 'nutrition_or_allergen_page') OR {any_sql(_SIGNAL_SQL, web.STRICT_MENU_WORDS)}) END", links=LINKS_SQL))
def filter_validated_sources(spark, sf_dir):
    return s.filter_validated_sources(typed_links(spark, sf_dir), include_ordering=True).select("link_id")


def _yields(df):
    n = F.col("link_id")
    return df.withColumns({"n_items": n * 7 % 40, "n_allergen": n % 3, "n_matrix": F.when(n % 11 == 0, 12).otherwise(0)})


@query("source_budget", "WI-10", with_tables(
    """SELECT restaurant_id, link_id FROM (
      WITH RECURSIVE todo AS (SELECT *, row_number() OVER (PARTITION BY restaurant_id ORDER BY position) AS slot FROM (SELECT f.*, link_id * 7 % 40 AS n_items, link_id % 3 AS n_allergen,
        CASE WHEN link_id % 11 = 0 THEN 12 ELSE 0 END AS n_matrix FROM final f WHERE kind <> 'allergy_info')),
      walk AS (SELECT restaurant_id, 0::BIGINT AS slot, 0::BIGINT AS taken, 0::BIGINT AS items, 0::BIGINT AS allergen, 0::BIGINT AS matrix, NULL::BIGINT AS link_id FROM (SELECT DISTINCT restaurant_id FROM todo)
        UNION ALL SELECT w.restaurant_id, t.slot, w.taken + take, w.items + take * n_items, w.allergen + take * n_allergen, w.matrix + take * n_matrix, CASE WHEN take = 1 THEN t.link_id END
        FROM walk w JOIN todo t ON t.restaurant_id = w.restaurant_id AND t.slot = w.slot + 1, LATERAL (SELECT CASE WHEN w.taken >= 4 OR w.matrix >= 10 OR ((w.allergen >= 3) AND w.items >= 30)
          OR (w.allergen >= 3 AND t.kind IN ('allergen', 'nutrition')) THEN 0 ELSE 1 END AS take))
      SELECT * FROM walk WHERE link_id IS NOT NULL)""", links=LINKS_SQL, kinded=KINDED_SQL, final=FINAL_SQL))
def source_budget(spark, sf_dir):
    ranked = _yields(s.finalize_candidates(kinded(spark, sf_dir), "link_id"))
    taken = s.source_budget(ranked)
    return ranked.join(taken.select("restaurant_id", "position"), ["restaurant_id", "position"], "left_semi").select("restaurant_id", "link_id")


@query("signal_pages", "WI-19", with_tables(
    "SELECT restaurant_id, link_id FROM " + first(
        "(SELECT *, CASE WHEN kind IN ('allergy_info', 'allergen', 'nutrition') THEN 0 WHEN link_id % 2 = 0 THEN 1 END AS p FROM final WHERE NOT ends_with("
        + BARE.format("url") + ", '.pdf'))", "restaurant_id", "p, position", 2).replace("FROM final WHERE NOT", "FROM final WHERE (kind IN ('allergy_info', 'allergen', 'nutrition') OR link_id % 2 = 0) AND NOT"),
    links=LINKS_SQL, kinded=KINDED_SQL, final=FINAL_SQL))
def signal_pages(spark, sf_dir):
    ranked = s.finalize_candidates(kinded(spark, sf_dir), "link_id").withColumn("url", F.concat("url", F.lit("#"), F.col("link_id").cast("string")))
    pages = ranked.select("url", F.when(F.col("link_id") % 2 == 0, "We promise a nut-free kitchen").otherwise("welcome").alias("text"),
                          F.when(u.is_pdf_url(F.col("url")), "pdf").otherwise("html").alias("source_type"))
    return s.signal_pages(ranked, pages).select("restaurant_id", "link_id")


@query("needs_recovery", "FI-16", with_tables(
    "SELECT l.restaurant_id, CAST(sum(n) AS BIGINT) AS n_items, bool_or(mm) AS city_mismatch, sum(n) < 8 OR bool_or(mm) AS needs_recovery FROM (SELECT restaurant_id, 1 AS n, "
    f"coalesce(city <> '' AND NOT url_has AND shown IS NOT NULL AND shown <> city, false) AS mm FROM {CITY_FACTS}) l GROUP BY 1", links=LINKS_SQL))
def needs_recovery(spark, sf_dir):
    rows = links(spark, sf_dir)
    restaurants = rows.select("restaurant_id", "name", "address").distinct()
    return s.needs_recovery(restaurants, rows.select("restaurant_id", F.col("url").alias("menu_source_url")))


def link_graph(spark, sf_dir):
    """Children of every link: derived documents and sub-pages."""
    kids = ["/drinks", "/brunch.pdf", "/careers", "/img/board.png", "/allergen-info", "/contact"]
    return links(spark, sf_dir).select(F.col("url").alias("page_url"), F.posexplode(text_array(kids)).alias("link_ord", "kid")).distinct().select(
        "page_url", "link_ord", F.concat(F.regexp_replace("page_url", "[?#].*$", ""), "kid").alias("url"), F.lit("").alias("anchor"))


_KIDS = sql_list(["/drinks", "/brunch.pdf", "/careers", "/img/board.png", "/allergen-info", "/contact"])
_FOLLOW = "NOT (" + ends_sql("regexp_replace(lower(url), '[?].*$', '')", [".pdf", *web.HOP_IMAGE_EXTENSIONS]) + ")"


@query("second_hop", "JN-22", with_tables(
    "SELECT restaurant_id, url, kind FROM " + first(
        "(SELECT p.restaurant_id, p.kind, p.pr, g.url, g.link_ord FROM parents p JOIN graph g ON g.page_url = p.url WHERE (" + ends_sql("lower(g.url)", [".pdf", *web.HOP_IMAGE_EXTENSIONS]) + " OR "
        + any_sql("lower(g.url)", web.SECOND_HOP_WORDS) + ") AND NOT EXISTS (SELECT 1 FROM kinded k WHERE k.restaurant_id = p.restaurant_id AND k.url = g.url))",
        "restaurant_id, url", "pr, link_ord"), links=LINKS_SQL, kinded=KINDED_SQL,
    parents="SELECT * FROM " + first(first(f"(SELECT *, {BARE.format('url')} AS nu, CASE kind WHEN 'allergen' THEN 0 WHEN 'nutrition' THEN 1 WHEN 'allergy_info' THEN 2 ELSE 3 END AS hop FROM kinded WHERE {_FOLLOW})",
                                           "restaurant_id, nu", "hop, link_id"), "restaurant_id", "hop, link_id", 3, "pr"),
    graph=f"SELECT page_url, i - 1 AS link_ord, regexp_replace(page_url, '[?#].*$', '') || {_KIDS}[i] AS url FROM (SELECT DISTINCT url AS page_url FROM links), (SELECT unnest(generate_series(1, 6)) AS i)"))
def second_hop(spark, sf_dir):
    return s.second_hop(kinded(spark, sf_dir), link_graph(spark, sf_dir), "link_id").select("restaurant_id", "url", "kind")


_NOISE = ("(len(list_filter(" + sql_list(web.SOCIAL_DOMAINS) + ", lambda d: h = d OR ends_with(h, '.' || d))) > 0)")


@query("site_fallback_candidates", "JN-32", with_tables(
    "SELECT p.restaurant_id, p.website_url AS url FROM places p WHERE website_url IS NOT NULL AND NOT EXISTS (SELECT 1 FROM kinded k WHERE 'c' || substr(k.restaurant_id, 2) = p.restaurant_id AND k.kind = 'menu') "
    "AND NOT EXISTS (SELECT 1 FROM kinded k WHERE 'c' || substr(k.restaurant_id, 2) = p.restaurant_id AND k.url = p.website_url)", places=PLACES_SQL, links=LINKS_SQL, kinded=KINDED_SQL))
def site_fallback_candidates(spark, sf_dir):
    candidates = kinded(spark, sf_dir).withColumn("restaurant_id", F.concat(F.lit("c"), F.substring("restaurant_id", 2, 10)))
    return s.site_fallback_candidates(places(spark, sf_dir), candidates).select("restaurant_id", "url")


@query("seed_urls", "TX-25", with_tables(
    "SELECT restaurant_id, unnest(CASE WHEN trim(regexp_extract(website_url, '^https?://[^/?#]*([^?#]*)', 1), '/') <> '' THEN [website_url, regexp_extract(website_url, '^(https?://[^/?#]*)', 1) || '/'] ELSE [website_url] END) AS seed_url "
    "FROM places WHERE website_url IS NOT NULL", places=PLACES_SQL))
def seed_urls(spark, sf_dir):
    return s.seed_urls(places(spark, sf_dir)).select("restaurant_id", "seed_url")


@query("probe_urls", "TX-25", with_tables(
    f"SELECT restaurant_id, regexp_extract(website_url, '^(https?://[^/?#]*)', 1) || path AS probe_url FROM places, (SELECT unnest({sql_list(web.ALLERGEN_PROBE_PATHS + web.ALLERGEN_PDF_PATHS)}) AS path) WHERE website_url IS NOT NULL",
    places=PLACES_SQL))
def probe_urls(spark, sf_dir):
    return s.probe_urls(places(spark, sf_dir)).select("restaurant_id", "probe_url")


@query("subdomain_seeds", "JN-21")
def subdomain_seeds(spark, sf_dir):
    rows = places(spark, sf_dir).where("website_url IS NOT NULL AND address IS NOT NULL")
    links_ = rows.select("restaurant_id", F.posexplode(F.transform(text_array(["cupertino.", "santamonica.", "london.", "shop."]), lambda p: F.concat(
        F.lit("https://"), p, u.registrable_domain(u.netloc(F.col("website_url"))), F.lit("/menu")))).alias("link_ord", "url"))
    return s.subdomain_seeds(links_, rows).select("restaurant_id", "seed_rank", "seed_url")


_PAGE_TEXTS = ["Official site of Golden Kitchen 123 Main St Cupertino", "Blue Diner London reviews", "call +1 555 010 0042", "unrelated words"]


def _web_results(spark, sf_dir):
    k = F.col("k")
    return places(spark, sf_dir).where("name IS NOT NULL").select(
        "restaurant_id", F.lit(0).alias("query_ord"), k.alias("result_ord"), F.coalesce("website_url", F.concat(F.lit("https://www."), pick(["yelp.com/x", "goldenkitchen.com/", "files.net/menu.pdf"], k))).alias("url"),
        F.col("name").alias("title"), F.lit("menu and allergens").alias("description"), pick(_PAGE_TEXTS, k).alias("page_text"))


@query("evaluate_website_candidates", "JN-16")
def evaluate_website_candidates(spark, sf_dir):
    found = s.evaluate_website_candidates(places(spark, sf_dir), _web_results(spark, sf_dir))
    return found.select("restaurant_id", "url", "confidence", "accepted", "rejection")


@query("search_results_to_sources", "JN-31")
def search_results_to_sources(spark, sf_dir):
    found = s.search_results_to_sources(_web_results(spark, sf_dir), places(spark, sf_dir))
    return found.select("restaurant_id", "url", "source_type", F.round("confidence", 3).alias("confidence"), "evidence_grade", "is_primary")


@query("allergen_sources", "JN-31")
def allergen_sources(spark, sf_dir):
    return s.allergen_sources(_web_results(spark, sf_dir), places(spark, sf_dir)).select("restaurant_id", "url", "position")


@query("snippet_bundle", "AG-35")
def snippet_bundle(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(
        (F.col("doc_id") % 25).alias("restaurant_id"), F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"), F.col("doc_id").alias("snippet_ord"), F.col("text").alias("blob"))
    return s.snippet_bundle(rows, F.lit("the thin")).select("restaurant_id", F.md5("bundle").alias("digest"), F.length("bundle").alias("n_chars"), "primary_url")


# --- Keyed caches --------------------------------------------------------------------------
def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("upsert_latest", "SC-8",
       "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id % 2 DESC) AS rn FROM events) WHERE rn = 1")
def upsert_latest(spark, sf_dir):
    e = _events(spark, sf_dir).select("user_id", "event_type", "event_id", "ts")
    return c.upsert_latest(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"], "ts").select("user_id", "event_type", "event_id")


@query("latest_valid_cache", "JN-23",
       "SELECT r.event_id AS request_id, r.user_id, CASE WHEN epoch_us(r.ts) - epoch_us(e.ts) <= CASE WHEN e.event_id % 4 = 0 THEN 86400000000 ELSE 604800000000 END THEN e.event_id END AS entry_id "
       "FROM (SELECT * FROM events WHERE event_type = 'view') r ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') e ON r.user_id = e.user_id AND r.ts >= e.ts")
def latest_valid_cache(spark, sf_dir):
    e = _events(spark, sf_dir).withColumnRenamed("ts", "at")
    requests = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("request_id"), "at")
    cache = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("entry_id"), "at", (F.col("event_id") % 4 == 0).alias("is_negative"))
    return c.latest_valid_cache(requests, cache, ["user_id"]).select("request_id", "user_id", "entry_id")


@query("two_tier_lookup", "JN-24",
       "SELECT c_custkey, coalesce(p.v, f.v) AS payload, CASE WHEN p.v IS NOT NULL THEN 'db' WHEN f.v IS NOT NULL THEN 'disk' END AS origin FROM customer c LEFT JOIN (SELECT o_custkey AS k, max(o_orderpriority) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) p "
       "ON p.k = c_custkey LEFT JOIN (SELECT o_custkey AS k, min(o_orderpriority) AS v FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) f ON f.k = c_custkey")
def two_tier_lookup(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    first_tier = orders.where("o_orderstatus = 'F'").groupBy("c_custkey").agg(F.max("o_orderpriority").alias("payload"))
    second_tier = orders.where("o_orderstatus = 'P'").groupBy("c_custkey").agg(F.min("o_orderpriority").alias("payload"))
    return c.two_tier_lookup(table(spark, sf_dir, "customer").select("c_custkey"), first_tier, second_tier, ["c_custkey"])


@query("pending", "JN-25", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def pending(spark, sf_dir):
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return c.pending(table(spark, sf_dir, "customer").select("c_custkey"), done, ["c_custkey"])


@query("attempts_last_60s", "WI-17",
       "SELECT event_id, count(*) OVER (PARTITION BY user_id % 5 ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS attempts FROM events")
def attempts_last_60s(spark, sf_dir):
    log = _events(spark, sf_dir).withColumn("client", F.col("user_id") % 5)
    return c.attempts_in_window(log, "client", "ts").select("event_id", "attempts")


@query("daily_cap", "ST-3", "SELECT CAST(ts AS DATE) AS day, count(*) AS n_requests, count(*) > 330 AS over_cap FROM events GROUP BY 1")
def daily_cap(spark, sf_dir):
    return c.daily_cap(_events(spark, sf_dir), "ts", 330)


