"""Row-local text expressions over documents, dishes and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from dinesight.catalog import query
from dinesight.catalog.tables import (
    DISHES_SQL, PLACES_SQL, dishes, pick, pick_sql, places, sql_list, table, with_tables)
from dinesight.functions import text as t
from dinesight.functions.literals import contains_any
from dinesight.vocab import allergens, web

_WS = r"[\t\n\x0B\f\r \x{85}\p{Z}]+"


def clean_sql(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '{_WS}', ' ', 'g'))"


def key_sql(expr: str) -> str:
    return f"regexp_replace(lower(coalesce({expr}, '')), '[^a-z0-9]+', '', 'g')"


def _document_query(name: str, covers: str, column, expr: str, sql_type: str = "") -> None:
    @query(name, covers, f"SELECT doc_id, {expr} AS result FROM documents")
    def run(spark, sf_dir):
        return table(spark, sf_dir, "documents").select("doc_id", column().alias("result"))


# Digests keep results small without shortening what is processed.
_document_query("norm_key", "PR-4", lambda: F.md5(t.norm_key(F.col("text"))), f"md5({key_sql('text')})")
_document_query("clean_text", "PR-5", lambda: F.md5(t.clean_text(F.col("text"))), f"md5({clean_sql('text')})")
_document_query("norm_ws", "PR-5", lambda: F.md5(t.norm_ws(F.col("text"))), f"md5(lower({clean_sql('text')}))")
_document_query("strip_ws", "PR-5", lambda: F.md5(t.strip_ws(F.col("text"))),
                f"md5(regexp_replace(lower(text), '{_WS}', '', 'g'))")
_document_query("slugify", "PR-6", lambda: t.slugify(F.concat_ws(" ", "lang", "source", F.col("text"))),
                "trim(regexp_replace(lower(trim(lang || ' ' || source || ' ' || text)), '[^a-z0-9]+', '_', 'g'), '_')")
_document_query(
    "fold_accents", "PR-7", lambda: F.md5(t.fold_accents(F.col("text"))),
    "md5(strip_accents(replace(replace(replace(replace(replace(lower(text), 'æ', 'ae'), 'ø', 'o'), 'ß', 'ss'), "
    "'ð', 'd'), 'þ', 'th')))")
_document_query(
    "norm_locality", "PR-7", lambda: F.md5(t.norm_locality(F.col("text"))),
    r"md5(regexp_replace(strip_accents(replace(lower(text), 'ß', 'ss')), '[^\p{L}\p{N}]+', '', 'g'))")
_document_query("trim_text", "PR-42", lambda: t.trim_text(F.col("text"), 400),
                f"CASE WHEN length({clean_sql('text')}) <= 400 THEN {clean_sql('text')} ELSE "
                f"trim(regexp_replace(left({clean_sql('text')}, 400), ' [^ ]*$', '')) END")

_PRICE_SQL = web.PRICE_PATTERN.replace("(?iU)", "(?i)").replace("'", "''")
_PRICED_TEXT = ["Soup $4.50 and salad €12,50", "Rs 350 or 1200円", "Set menu 18 EUR, tea 3", "no price here", "1,234.56 total"]


@query("extract_prices", "TX-4",
       f"SELECT doc_id, array_to_string(regexp_extract_all(t, '{_PRICE_SQL}'), '|') AS prices, "
       f"CAST(len(regexp_extract_all(t, '{_PRICE_SQL}')) AS BIGINT) AS n "
       f"FROM (SELECT doc_id, text || ' ' || {pick_sql(_PRICED_TEXT, 'doc_id')} AS t FROM documents)")
def extract_prices(spark, sf_dir):
    text = F.concat(F.col("text"), F.lit(" "), pick(_PRICED_TEXT, F.col("doc_id")))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(t.extract_prices(text), "|").alias("prices"),
        t.price_count(text).cast("bigint").alias("n"))


_LINES = ["Soup of the day 12", "Steak 250 g 24", "Open 11 am", "Flight 300 kcal", "section 12 applies", "Toast 5.5 and jam 180",
          "Pad Thai $14", "abv 5 beer 7"]


@query("plausible_bare_price", "FI-14")
def plausible_bare_price(spark, sf_dir):
    line = F.concat(pick(_LINES, F.col("doc_id")), F.lit(" "), F.col("source"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(t.line_prices(line, allow_bare=True), "|").alias("prices"))


@query("dedupe_keys", "PR-31", with_tables(
    "SELECT arrival, trim(regexp_replace(replace(lower(item_name || ' & ' || description), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) "
    "AS name_key, coalesce(CAST(CAST(nullif(regexp_extract(price, '[0-9]+', 0), '') AS BIGINT) AS VARCHAR), '') AS price_key, "
    "CAST(nullif(regexp_extract(price, '[0-9]+', 0), '') AS DECIMAL(12,2)) AS price_value FROM dishes", dishes=DISHES_SQL))
def dedupe_keys(spark, sf_dir):
    return dishes(spark, sf_dir).select(
        "arrival", t.dedupe_text(F.concat_ws(" & ", "item_name", "description")).alias("name_key"),
        t.dedupe_price(F.col("price")).alias("price_key"), t.price_value(F.col("price")).alias("price_value"))


_DECORATED = ["Margherita (Small)", "Latte - Large", "Cola 12 oz", "Club Sandwich", "House Special (Spicy) - Mini", "Bagel, Regular"]


@query("strip_size_suffix", "PR-33",
       "SELECT doc_id, trim(regexp_replace(trim(n), '(?i)(?:(?:\\s*\\([^)]*\\)|\\s*[-–—,]?\\s*(?:small|medium|large|regular|reg|kids?"
       "|mini|x-?large|x-?l|sm|md|lg|[0-9]+\\s*(?:oz|inch|in|cm|\")))\\s*)+$', '')) AS base FROM "
       f"(SELECT doc_id, {pick_sql(_DECORATED, 'doc_id')} AS n FROM documents)")
def strip_size_suffix(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", t.strip_size_suffix(pick(_DECORATED, F.col("doc_id"))).alias("base"))


@query("split_name_description", "PR-32")
def split_name_description(spark, sf_dir):
    raw = F.concat_ws(" ", "item_name", "description")
    return dishes(spark, sf_dir).select("arrival", t.split_name_description(raw).alias("s")).select(
        "arrival", "s.name", "s.description")


_CONFIDENCE_SQL = (
    "round(least(0.55 + CASE WHEN trim(category) <> '' THEN 0.15 ELSE 0 END + CASE WHEN trim(description) <> '' THEN 0.15 ELSE 0 END"
    " + CASE WHEN len(allergen_terms) + len(dietary_terms) > 0 THEN 0.1 ELSE 0 END, 0.95), 2)")


@query("item_confidence", "PR-30", with_tables(
    f"SELECT arrival, CAST({_CONFIDENCE_SQL} AS DOUBLE) AS parsed, CAST(round(least(0.9 + CASE WHEN price <> '' THEN 0.05 ELSE 0 END + "
    "CASE WHEN category <> '' THEN 0.03 ELSE 0 END + CASE WHEN description <> '' THEN 0.02 ELSE 0 END, 0.99), 2) AS DOUBLE) AS declared "
    "FROM dishes", dishes=DISHES_SQL))
def item_confidence(spark, sf_dir):
    has_terms = (F.size("allergen_terms") > 0) | (F.size("dietary_terms") > 0)
    return dishes(spark, sf_dir).select(
        "arrival", t.item_confidence(F.col("category"), F.col("description"), has_terms).alias("parsed"),
        t.schema_item_confidence(F.col("price"), F.col("category"), F.col("description")).alias("declared"))


def _any_sql(expr: str, values: list[str]) -> str:
    return f"len(list_filter({sql_list(values)}, lambda v: contains({expr}, v))) > 0"


def _repeat_sql(expr: str) -> str:
    words = f"list_filter(string_split_regex({expr}, '\\s+'), lambda w: length(w) > 0)"
    return f"(len({words}) >= 4 AND len(list_distinct(list_transform({words}, lambda w: lower(w)))) <= len({words}) // 2)"


_NAMED = f"(SELECT arrival, item_name || {pick_sql(['', ' with', ' and Rice and Rice and', ' 123456789', ' add to cart'], 'k')} AS n FROM dishes)"


@query("item_name_gates", "FI-5 FI-6", with_tables(
    "SELECT arrival, length(n) BETWEEN 2 AND 80 AND lower(n) NOT IN ('subtotal', 'total', 'delivery', 'service fee') "
    f"AND NOT ({_any_sql('lower(n)', web.NEGATIVE_ITEM_WORDS)}) AND regexp_matches(n, '\\p{{L}}') "
    f"AND NOT list_contains({sql_list(web.NON_DISH_EXACT)}, regexp_replace(lower(n), '^[ .!*#|]+|[ .!*#|]+$', '', 'g')) "
    f"AND NOT ({_any_sql('lower(n)', web.NON_DISH_PHRASES)}) AND NOT {_repeat_sql('n')} AND NOT regexp_matches(n, '^[(\\[\"¡¿]*\\p{{Ll}}') "
    f"AND len(list_filter({sql_list(web.NAME_END_CONNECTORS)}, lambda v: ends_with(rtrim(lower(n)), v))) = 0 "
    "AND len(list_filter(string_split_regex(n, '\\s+'), lambda w: length(w) > 0)) <= 10 "
    "AND len(regexp_extract_all(n, '[0-9]')) / CAST(length(n) AS DOUBLE) <= 0.5 AS is_item, "
    f"length(trim(lower(n))) <= 45 AND list_contains({sql_list(sorted(set(web.CATEGORY_LINES)))}, "
    f"trim(regexp_replace(trim(lower(n)), '[^a-z0-9]+', ' ', 'g'))) AS is_category FROM {_NAMED}", dishes=DISHES_SQL))
def item_name_gates(spark, sf_dir):
    suffix = pick(["", " with", " and Rice and Rice and", " 123456789", " add to cart"], F.col("k"))
    name = F.concat("item_name", suffix)
    return dishes(spark, sf_dir).select("arrival", t.looks_like_item_name(name).alias("is_item"),
                                        t.looks_like_category(name).alias("is_category"))


@query("eval_item_quality", "PR-39", with_tables(
    "SELECT arrival, price <> '' AND (regexp_matches(price, '[$€£¥₹฿₩₫₪₴₦]') OR regexp_matches(price, '[0-9]+[.,][0-9]{2}([^0-9]|$)')) AS price_ok, "
    "length(trim(n)) NOT BETWEEN 2 AND 60 OR NOT regexp_matches(n, '(?i)[a-zÀ-ʸऀ-퟿]') "
    f"OR list_contains({sql_list(web.NON_DISH_EXACT)}, regexp_replace(lower(trim(n)), '^[ .!*#|]+|[ .!*#|]+$', '', 'g')) "
    f"OR {_any_sql('lower(n)', web.NON_DISH_PHRASES)} OR {_repeat_sql('trim(n)')} OR regexp_matches(trim(n), '^\\p{{Ll}}') "
    f"OR list_contains({sql_list(web.NOISE_MODIFIERS)}, lower(trim(n))) "
    f"OR len(list_filter({sql_list(web.NOISE_ENDINGS)}, lambda v: ends_with(lower(trim(n)), v))) > 0 "
    f"OR {_any_sql('lower(trim(n))', web.NOISE_UI_WORDS)} "
    "OR len(list_filter(string_split_regex(n, '\\s+'), lambda w: length(w) > 0)) > 8 "
    "OR len(regexp_extract_all(n, '[0-9]')) / CAST(length(trim(n)) AS DOUBLE) > 0.4 AS is_noise "
    f"FROM (SELECT arrival, price, item_name || {pick_sql(['', ' with', ' and Rice and Rice and', ' 123456789', ' add to cart'], 'k')} AS n FROM dishes)",
    dishes=DISHES_SQL))
def eval_item_quality(spark, sf_dir):
    suffix = pick(["", " with", " and Rice and Rice and", " 123456789", " add to cart"], F.col("k"))
    return dishes(spark, sf_dir).select("arrival", t.price_ok(F.col("price")).alias("price_ok"),
                                        t.looks_noise(F.concat("item_name", suffix)).alias("is_noise"))


@query("has_value_and_quality", "PR-2 PR-3", with_tables(
    "SELECT restaurant_id, coalesce(trim(source_last_updated) <> '', false) AS dated, round((CAST(name IS NOT NULL AS INT) + "
    "CAST(address IS NOT NULL AS INT) + CAST(website_url IS NOT NULL AS INT) + CAST(phone_number IS NOT NULL AS INT) + "
    "CAST(opening_hours IS NOT NULL AS INT) + CAST(len(categories) > 0 AS INT) + "
    "CAST(coalesce(trim(source_last_updated) <> '', false) AS INT)) / CAST(7 AS DOUBLE), 3) AS quality FROM places", places=PLACES_SQL))
def has_value_and_quality(spark, sf_dir):
    from dinesight.operators.entities import QUALITY_KINDS
    return places(spark, sf_dir).select("restaurant_id", t.has_value(F.col("source_last_updated")).alias("dated"),
                                        t.quality_score(QUALITY_KINDS).alias("quality"))


_NAMES_IN = ["the red tulip", "is and", "for that", "zzz qqq"]
_TOK = f"list_filter(string_split({pick_sql(_NAMES_IN, 'doc_id')}, ' '), lambda w: length(w) >= 3)"
_LOW = f"lower({clean_sql('text')})"


@query("mentions_entity", "FI-9",
       f"SELECT doc_id, contains(replace(low, ' ', ''), replace(name, ' ', '')) OR (len(tok) > 0 AND hits = len(tok)) AS strict_hit, "
       "contains(replace(low, ' ', ''), replace(name, ' ', '')) OR (len(tok) > 0 AND hits >= greatest(1, (len(tok) + 1) // 2)) AS majority_hit "
       "FROM (SELECT *, len(list_filter(tok, lambda w: contains(low, w))) AS hits FROM "
       f"(SELECT doc_id, {_LOW} AS low, {pick_sql(_NAMES_IN, 'doc_id')} AS name, {_TOK} AS tok FROM documents))")
def mentions_entity(spark, sf_dir):
    name = pick(_NAMES_IN, F.col("doc_id"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", t.mentions_entity(F.col("text"), name).alias("strict_hit"),
        t.mentions_entity(F.col("text"), name, mode="majority").alias("majority_hit"))


_CLAIMS = ["a nut-free kitchen", "food allergy notice", "free from nuts", "great pasta", "cross contamination risk"]


@query("allergy_prefilter", "FI-10",
       f"SELECT doc_id, {_any_sql('low', allergens.NUT_FREE_PAGE_WORDS)} AS nut_free, "
       "regexp_matches(low, 'allerg|cross.?contam|nut[\\s-]?free|gluten|dietary|intoleran|peanut|tree nut') AS allergy_text "
       f"FROM (SELECT doc_id, lower(text || ' ' || {pick_sql(_CLAIMS, 'doc_id')}) AS low FROM documents)")
def allergy_prefilter(spark, sf_dir):
    low = F.lower(F.concat(F.col("text"), F.lit(" "), pick(_CLAIMS, F.col("doc_id"))))
    return table(spark, sf_dir, "documents").select(
        "doc_id", contains_any(low, allergens.NUT_FREE_PAGE_WORDS).alias("nut_free"),
        low.rlike(web.ALLERGY_TEXT).alias("allergy_text"))


_HEADER_LINES = ["Milk Egg Peanut", "Allergen chart", "Milk and honey", "Weizen, Soja, Senf, Sellerie", "plain words"]


@query("grid_prefilter", "FI-11",
       f"SELECT doc_id, {_any_sql('low', allergens.CHART_GRID_WORDS)} OR len(list_distinct(list_filter(["
       + ", ".join(f"CASE WHEN {_any_sql('low', forms)} THEN '{token}' END" for token, forms in allergens.CHART_HEADERS)
       + f"], lambda v: v IS NOT NULL))) >= 3 AS may_hold_grid FROM (SELECT doc_id, lower(text || ' ' || {pick_sql(_HEADER_LINES, 'doc_id')}) AS low FROM documents)")
def grid_prefilter(spark, sf_dir):
    from dinesight.operators.tagging import grid_prefilter as may_hold_grid
    text = F.concat(F.col("text"), F.lit(" "), pick(_HEADER_LINES, F.col("doc_id")))
    return table(spark, sf_dir, "documents").select("doc_id", may_hold_grid(text).alias("may_hold_grid"))


