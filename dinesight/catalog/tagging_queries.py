"""Vocabulary tagging, implied allergens and dish priors."""

from __future__ import annotations

from pyspark.sql import functions as F

from dinesight.catalog import query
from dinesight.catalog.place_queries import CUISINES
from dinesight.catalog.tables import (
    DISHES_SQL, PLACES_SQL, dishes, pick, pick_sql, places, sql_list, sql_text, table, with_tables)
from dinesight.functions.literals import text_array
from dinesight.operators import entities as e
from dinesight.operators import tagging as tg
from dinesight.vocab import allergens as av
from dinesight.vocab import cuisines as cv
from dinesight.vocab import ingredients as iv

TERMS = ["tion", "ther", "ing", "sch", "und", "queau", "ment", "cion", "erst", "that", "edre", "wheat"]
FRIENDS = {"tion": ["tion", "ertion", "attion"], "that": ["thatin"], "ing": ["ing", "thing", "ering"]}


def _tag_hit(term: str) -> str:
    """Present in a word that is not one of the term's false friends."""
    friends = FRIENDS.get(term, [])
    return (f"len(list_filter(ws, lambda w: contains(w, {sql_text(term)}) AND NOT list_contains({sql_list(friends) if friends else '[]::VARCHAR[]'}, w))) > 0")


@query("tag_terms", "JN-5",
       "SELECT term, lang, source, count(*) AS n_docs FROM (SELECT lang, source, unnest(list_filter(["
       + ", ".join(f"CASE WHEN {_tag_hit(t)} THEN {sql_text(t)} END" for t in TERMS)
       + r"], lambda v: v IS NOT NULL)) AS term FROM (SELECT *, string_split_regex(lower(text), '[^\p{L}]+') AS ws FROM documents)) GROUP BY ALL")
def tag_terms(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return tg.tag_terms(docs, "text", TERMS, ["doc_id", "lang", "source"], FRIENDS).groupBy("term", "lang", "source").agg(
        F.count("*").alias("n_docs"))


def _vocabulary(spark, sf_dir):
    words = F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))).alias("term")
    return table(spark, sf_dir, "benchmark").select(words).where("length(term) BETWEEN 5 AND 7").distinct()


_VOCABULARY = ("SELECT DISTINCT term FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) AS term FROM benchmark) "
               "WHERE length(term) BETWEEN 5 AND 7")


@query("tag_terms_vocabulary", "JN-5",
       f"SELECT term, count(*) AS n_turns FROM conversations JOIN ({_VOCABULARY}) ON contains(lower(text), term) GROUP BY term")
def tag_terms_vocabulary(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return tg.tag_terms(turns, "text", _vocabulary(spark, sf_dir), ["conv_id", "turn"]).groupBy("term").agg(F.count("*").alias("n_turns"))


@query("vocab_gap", "JN-26",
       f"SELECT term FROM ({_VOCABULARY}) v WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT w FROM (SELECT unnest(string_split_regex(lower(text), "
       "'[^a-z]+')) AS w FROM conversations WHERE role = 'user') WHERE length(w) BETWEEN 3 AND 4) u WHERE contains(v.term, u.w))")
def vocab_gap(spark, sf_dir):
    words = F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("term")
    right = table(spark, sf_dir, "conversations").where("role = 'user'").select(words).where("length(term) BETWEEN 3 AND 4").distinct()
    return tg.vocab_gap(_vocabulary(spark, sf_dir), right)


# --- Implied allergens -------------------------------------------------------------
def _re_any(variants: list[str]) -> str:
    import re
    return "(^|[^a-z])(" + "|".join(re.escape(v).replace("\\ ", " ").replace("\\-", "-").replace("'", "''") for v in variants) + ")s?([^a-z]|$)"


def _found(tier: str) -> str:
    cases = []
    for rule in iv.ingredient_rules():
        if rule["tier"] == tier:
            local = "norm"
            for phrase in rule["exclusions"]:
                local = f"replace({local}, {sql_text(phrase)}, '  ')"
            cases.append(f"CASE WHEN regexp_matches({local}, '{_re_any(rule['variants'])}') THEN {sql_list(rule['tokens'])} ELSE []::VARCHAR[] END")
    return "flatten([" + ", ".join(cases) + "])"


_SUPPRESSED = "flatten([" + ", ".join(
    f"CASE WHEN regexp_matches(norm, '{_re_any(list(p))}') THEN {sql_list(list(t))} ELSE []::VARCHAR[] END" for p, t in iv.FREE_FROM) + "])"
# Distinct dish texts are few; infer once per text and join back.
INFERRED = (
    "SELECT DISTINCT item_name, description, list_sort(list_filter(list_distinct(def0), lambda v: NOT list_contains(sup, v))) AS definite, "
    "list_sort(list_filter(list_distinct(may0), lambda v: NOT list_contains(sup, v) AND NOT list_contains(def0, v))) AS may FROM (SELECT *, "
    f"{_found('def')} AS def0, {_found('may')} AS may0, {_SUPPRESSED} AS sup FROM (SELECT DISTINCT item_name, description, "
    "' ' || lower(item_name || ' ' || description) || ' ' AS norm FROM dishes))")


@query("infer_ingredient_allergens", "JN-6", with_tables(
    "SELECT d.arrival, array_to_string(i.definite, ',') AS definite, array_to_string(i.may, ',') AS may FROM dishes d JOIN inferred i "
    "ON d.item_name = i.item_name AND d.description = i.description", dishes=DISHES_SQL, inferred=INFERRED))
def infer_ingredient_allergens(spark, sf_dir):
    text = F.concat_ws(" ", "item_name", "description")
    return dishes(spark, sf_dir).select("arrival", tg.infer_allergens(text).alias("i")).select(
        "arrival", F.array_join("i.definite", ",").alias("definite"), F.array_join("i.may", ",").alias("may"))


@query("enrich_inferred", "TX-18", with_tables(
    "SELECT arrival, array_to_string(list_sort(terms), ',') AS allergen_terms, array_to_string(list_sort(list_distinct(list_concat(cross_contact_terms, "
    "list_filter(may, lambda v: NOT list_contains(terms, v))))), ',') AS cross_contact_terms FROM (SELECT d.arrival, d.cross_contact_terms, "
    "CASE WHEN contains(extraction_method, 'matrix') THEN []::VARCHAR[] ELSE i.may END AS may, list_distinct(list_concat(d.allergen_terms, "
    "CASE WHEN contains(extraction_method, 'matrix') THEN []::VARCHAR[] ELSE i.definite END)) AS terms FROM dishes d JOIN inferred i "
    "ON d.item_name = i.item_name AND d.description = i.description)", dishes=DISHES_SQL, inferred=INFERRED))
def enrich_inferred(spark, sf_dir):
    rows = tg.enrich_inferred(dishes(spark, sf_dir).withColumn("raw_text", F.lit("")))
    return rows.select("arrival", F.array_join(F.array_sort("allergen_terms"), ",").alias("allergen_terms"),
                       F.array_join(F.array_sort("cross_contact_terms"), ",").alias("cross_contact_terms"))


_CHART = "CASE " + " ".join(
    f"WHEN len(list_filter({sql_list(forms)}, lambda v: contains(probe, v))) > 0 THEN '{token}'" for token, forms in av.CHART_HEADERS) + " END"
_HEADERS = ["Coconut", "Milk / Milch", "Tree Nuts", "Walnuss", "Calories", "Soja", "Crustaceans", "Peanut", "Fisch"]
_CANON = "CASE replace(lower(trim(h)), '_', ' ') " + " ".join(
    f"WHEN {sql_text(form)} THEN '{key}'" for key, forms in av.ALLERGEN_FORMS.items() for form in dict.fromkeys([key.replace("_", " "), *forms])) + " END"


@query("allergen_headers", "RS-7 TX-9",
       f"SELECT page_id, {_CHART} AS token, {_CANON} AS canonical FROM (SELECT page_id, h, replace(lower(trim(h)), 'coconut', ' ') AS probe "
       f"FROM (SELECT page_id, {pick_sql(_HEADERS, 'page_id')} AS h FROM pages))")
def allergen_headers(spark, sf_dir):
    header = pick(_HEADERS, F.col("page_id"))
    return table(spark, sf_dir, "pages").select("page_id", tg.chart_token(header).alias("token"),
                                                tg.canonical_allergen(header).alias("canonical"))


# --- Dish priors ------------------------------------------------------------------------
def _values(rows: list[dict], columns: list[str]) -> str:
    def cell(v):
        return sql_list(v) + "::VARCHAR[]" if isinstance(v, list) else (sql_text(v) if isinstance(v, str) else repr(v))
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(cell(r[c]) for c in columns) + ")" for r in rows) + f") t({', '.join(columns)})"


KB_SQL = _values(cv.dish_rules(), ["pattern", "families", "risk", "note", "nuts", "ord"])
SUSPECT_SQL = _values(cv.suspected_rules(), ["pattern", "families", "note", "ord"])
_MASKED = "regexp_replace(regexp_replace(' ' || txt || ' ', '([^a-z])(guacamoles|guacamole|molecular)([^a-z])', '\\1 \\3', 'g'), '([^a-z])(macaroons|macaroon)([^a-z])', '\\1 \\3', 'g')"
TEXTS_SQL = "SELECT DISTINCT item_name, description, txt, " + _MASKED + " AS masked FROM (SELECT *, trim(lower(item_name || ' ' || description)) AS txt FROM dishes)"


def best_sql(families: str, nuts: str) -> str:
    return ("(SELECT {{risk: k.risk, note: k.note}} FROM kb k WHERE contains(t.masked, k.pattern) AND list_has_any(k.families, {f}) AND "
            "({n} IS NULL OR len(k.nuts) = 0 OR list_has_any(k.nuts, {n})) ORDER BY k.risk DESC, k.ord LIMIT 1)").format(f=families, n=nuts)


_SEL = "CASE WHEN d.k % 3 = 1 THEN ['almond', 'pine_nut'] END"


@query("dish_prior", "JN-7", with_tables(
    "SELECT d.arrival, CAST(b.b.risk AS DOUBLE) AS risk, b.b.note AS note FROM (SELECT *, " + _SEL + " AS sel FROM dishes d) d LEFT JOIN (SELECT t.item_name, t.description, sel, "
    + best_sql("CASE WHEN s.sel IS NULL THEN ['peanuts', 'tree_nuts'] ELSE ['tree_nuts'] END", "s.sel")
    + " AS b FROM texts t, (SELECT NULL::VARCHAR[] AS sel UNION ALL SELECT ['almond', 'pine_nut']) s) b ON d.item_name = b.item_name AND d.description = b.description "
    "AND d.sel IS NOT DISTINCT FROM b.sel", dishes=DISHES_SQL, kb=KB_SQL, texts=TEXTS_SQL))
def dish_prior(spark, sf_dir):
    selection = F.when(F.col("k") % 3 == 1, text_array(["almond", "pine_nut"]))
    families = F.when(selection.isNull(), text_array(["peanuts", "tree_nuts"])).otherwise(text_array(["tree_nuts"]))
    text = tg.dish_text(F.col("item_name"), F.col("description"))
    return dishes(spark, sf_dir).select("arrival", "k", tg.dish_hits(text).alias("hits")).select(
        "arrival", tg.best_dish(F.col("hits"), families, selection).alias("b")).select("arrival", "b.risk", "b.note")


@query("suspected_match", "JN-8", with_tables(
    "SELECT d.arrival, CASE WHEN s.note IS NOT NULL THEN s.note WHEN d.k % 4 = 0 AND s.dairy IS NOT NULL THEN 'plant-based ''' || s.dairy || ''' is usually cashew-based' END AS note "
    "FROM dishes d JOIN (SELECT t.item_name, t.description, (SELECT note FROM suspects k WHERE contains(t.txt, k.pattern) ORDER BY ord LIMIT 1) AS note, "
    f"list_filter({sql_list(cv.VEGAN_SUSPECTED)}, lambda p: contains(t.txt, p))[1] AS dairy FROM texts t) s ON d.item_name = s.item_name AND d.description = s.description",
    dishes=DISHES_SQL, suspects=SUSPECT_SQL, texts=TEXTS_SQL))
def suspected_match(spark, sf_dir):
    text = tg.dish_text(F.col("item_name"), F.col("description"))
    cuisines = F.when(F.col("k") % 4 == 0, text_array(["vegan"])).otherwise(text_array(["thai"]))
    return dishes(spark, sf_dir).select("arrival", "k", text.alias("t")).select("arrival", tg.first_suspected(
        tg.suspected_hits(F.col("t")), F.col("t"), text_array(["peanuts", "tree_nuts"]), cuisines).alias("note"))


KB_ROWS = [("milk", "alfredo", 0.95, "cream sauce", 0), ("milk", "cheese", 0.9, "named dairy", 1), ("milk", "pizza", 0.8, "cheese topping", 2),
           ("gluten", "pizza", 0.9, "wheat dough", 3), ("gluten", "udon", 0.95, "wheat noodles", 4), ("egg", "macaron", 0.7, "meringue", 5),
           ("soy", "tofu", 0.95, "soy curd", 6), ("soy", "soy sauce", 0.95, "soy", 7), ("milk", "butter", 0.6, "butter", 8), ("gluten", "panko", 0.9, "crumbs", 9)]


def knowledge_base(spark):
    return spark.createDataFrame(KB_ROWS, "allergen string, pattern string, risk double, note string, ord int")


GENERIC_KB_SQL = _values([dict(zip(("allergen", "pattern", "risk", "note", "ord"), r)) for r in KB_ROWS], ["allergen", "pattern", "risk", "note", "ord"])


@query("generic_dish_prior", "JN-9", with_tables(
    "SELECT d.arrival, b.allergen, CAST(b.risk AS DOUBLE) AS risk, b.note FROM dishes d JOIN (SELECT * FROM (SELECT t.item_name, t.description, g.*, "
    "row_number() OVER (PARTITION BY t.item_name, t.description, g.allergen ORDER BY g.risk DESC, g.ord) AS rn FROM texts t JOIN gkb g ON contains(t.txt, g.pattern)) WHERE rn = 1) b "
    "ON d.item_name = b.item_name AND d.description = b.description", dishes=DISHES_SQL, texts=TEXTS_SQL, gkb=GENERIC_KB_SQL))
def generic_dish_prior(spark, sf_dir):
    return tg.generic_dish_prior(dishes(spark, sf_dir), knowledge_base(spark), ["arrival"])


_REGIONS = ["US", "TH", "MX", "unknown"]
_S_PLACES = f"SELECT 's' || CAST(k AS VARCHAR) AS restaurant_id, cuisines, {pick_sql(_REGIONS, 'k')} AS region FROM {CUISINES} WHERE source_name = 'openstreetmap'"
_HOMES = "MAP {" + ", ".join(f"'{c}': {sql_list(v)}" for c, v in cv.CUISINE_HOME.items()) + "}"
_BASE = ("CASE WHEN len(cuisines) = 0 THEN 0.3 ELSE list_max(list_transform(cuisines, lambda c: CASE c "
         + " ".join(f"WHEN '{c}' THEN {v}" for c, v in cv.CUISINE_BASELINE.items()) + " ELSE 0.3 END)) END")
PRIOR_PLACES = (f"SELECT *, len(list_filter(cuisines, lambda c: coalesce(list_contains({_HOMES}[c], region), false))) > 0 AS home, "
                f"CAST({_BASE} AS DOUBLE) AS base0, CASE WHEN len(cuisines) = 0 THEN 0.25 ELSE 0.4 END AS conf0 FROM ({_S_PLACES})")


def facts_sql(families: str, nuts: str, suspect: str = "") -> str:
    """What each dish text says of the wanted nuts; ``suspect`` narrows the suspects."""
    return (f"SELECT t.*, len(list_filter({sql_list(av.NUT_FREE_CLAIMS)}, lambda p: contains(t.txt, p))) > 0 AS claim, "
            + best_sql(families, nuts) + f" AS dish, (SELECT note FROM suspects k WHERE contains(t.txt, k.pattern){suspect} ORDER BY ord LIMIT 1) AS sus, "
            f"list_filter({sql_list(cv.VEGAN_SUSPECTED)}, lambda p: contains(t.txt, p))[1] AS dairy FROM texts t")


FACTS_SQL = facts_sql("['peanuts', 'tree_nuts']", "NULL::VARCHAR[]")
_SUS = "(f.sus IS NOT NULL OR (list_has_any(p.cuisines, ['vegan', 'vegetarian']) AND f.dairy IS NOT NULL))"
_CLOSED = "least(0.97, p.base0 * CASE WHEN p.home THEN 1.25 ELSE 1 END)"
ITEM_PRIOR_SQL = (
    f"SELECT d.*, p.cuisines, p.region, {_CLOSED} AS base_risk, CAST(CASE WHEN f.claim THEN 0.08 WHEN f.dish IS NOT NULL THEN least(0.97, f.dish.risk * CASE WHEN p.home THEN 1.1 ELSE 1 END) "
    f"WHEN {_SUS} THEN greatest({_CLOSED}, 0.4) ELSE {_CLOSED} END AS DOUBLE) AS prior_risk, CAST(CASE WHEN f.claim THEN 0.6 WHEN f.dish IS NOT NULL THEN 0.8 WHEN {_SUS} THEN 0.3 ELSE p.conf0 END AS DOUBLE) AS prior_confidence, "
    f"CASE WHEN f.claim THEN 'nut_free_claim' WHEN f.dish IS NOT NULL THEN 'dish_knowledge' WHEN {_SUS} THEN 'suspected_nuts' WHEN len(p.cuisines) = 0 THEN 'default' ELSE 'cuisine_baseline' END AS prior_basis "
    "FROM dishes d JOIN facts f ON d.item_name = f.item_name AND d.description = f.description JOIN pplaces p ON d.restaurant_id = p.restaurant_id")
PRIOR_TABLES = dict(dishes=DISHES_SQL, places=PLACES_SQL, kb=KB_SQL, suspects=SUSPECT_SQL, texts=TEXTS_SQL, pplaces=PRIOR_PLACES, facts=FACTS_SQL)


def scored_dishes(spark, sf_dir):
    """Dishes beside their restaurant's cuisines and region."""
    rest = places(spark, sf_dir).where("source_name = 'openstreetmap'").select(
        "restaurant_id", e.cuisines_for(F.col("categories"), F.col("name")).alias("cuisines"), pick(_REGIONS, F.col("k")).alias("region"))
    return dishes(spark, sf_dir).join(rest, "restaurant_id")


@query("item_prior", "RS-1", with_tables(
    f"SELECT arrival, round(prior_risk, 4) AS prior_risk, prior_confidence, prior_basis FROM ({ITEM_PRIOR_SQL})", **PRIOR_TABLES))
def item_prior(spark, sf_dir):
    rows = tg.item_prior(scored_dishes(spark, sf_dir), text_array(["peanuts", "tree_nuts"]), F.lit(None).cast("array<string>"),
                         F.col("cuisines"), F.col("region"))
    return rows.select("arrival", F.round("prior_risk", 4).alias("prior_risk"), "prior_confidence", "prior_basis")


