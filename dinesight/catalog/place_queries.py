"""Places: filters, cuisines, matching, nearby, registry, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from dinesight.catalog import query
from dinesight.catalog.source_queries import domain_sql
from dinesight.catalog.tables import PLACES_SQL, pick, pick_sql, places, sql_list, table, with_tables
from dinesight.functions import geo
from dinesight.functions.text import quality_score
from dinesight.operators import entities as e
from dinesight.sources import places as sources
from dinesight.vocab import cuisines as cv
from dinesight.vocab import places as pv

DIST = ("2 * 6371000 * atan2(sqrt({a}), sqrt(1 - {a}))")
_A = ("(power(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * power(sin(radians({lon2} - {lon1}) / 2), 2))")


def dist_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return DIST.format(a=_A.format(lat1=lat1, lon1=lon1, lat2=lat2, lon2=lon2))


@query("haversine", "PR-1", with_tables(
    f"SELECT restaurant_id, round({dist_sql('latitude', 'longitude', '37.02', '-121.98')}, 3) AS metres FROM places", places=PLACES_SQL))
def haversine(spark, sf_dir):
    return places(spark, sf_dir).select("restaurant_id", F.round(geo.haversine_m(
        F.col("latitude"), F.col("longitude"), F.lit(37.02), F.lit(-121.98)), 3).alias("metres"))


@query("validate_coordinates", "PR-38",
       "SELECT c_custkey, lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AS valid FROM (SELECT c_custkey, "
       "CAST(c_custkey % 200 - 100 AS DOUBLE) AS lat, CAST(c_custkey % 400 - 200 AS DOUBLE) AS lon FROM customer)")
def validate_coordinates(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", geo.valid_coordinates(
        (k % 200 - 100).cast("double"), (k % 400 - 200).cast("double")).alias("valid"))


_LOWS = "list_transform(list_filter(categories, lambda c: length(trim(c)) > 0), lambda c: trim(lower(c)))"
_PRIMARY = ("coalesce(list_transform(list_filter(" + _LOWS + ", lambda c: starts_with(c, 'primary_type:')), "
            "lambda c: regexp_replace(c, '^[^:]*:', ''))[1], '')")
_TOKENS = f"array_to_string(list_transform({_LOWS}, lambda c: trim(regexp_replace(c, '^[^:]*:', ''))), ' ')"


def _has(expr: str, values: list[str]) -> str:
    return f"len(list_filter({sql_list(values)}, lambda v: contains({expr}, v))) > 0"


@query("is_food_place", "FI-1", with_tables(
    f"SELECT restaurant_id, CASE WHEN {_has(_PRIMARY, pv.NON_FOOD_TYPES)} THEN false WHEN {_has(_PRIMARY, pv.FOOD_TYPES)} THEN true "
    f"WHEN {_has(_TOKENS, pv.NON_FOOD_TYPES)} THEN false ELSE {_has(_TOKENS, pv.FOOD_TYPES)} END AS is_food FROM places", places=PLACES_SQL))
def is_food_place(spark, sf_dir):
    return places(spark, sf_dir).select("restaurant_id", e.is_food_place(F.col("categories")).alias("is_food"))


_ALIASES = ", ".join(f"{sql_list([k])[1:-1]}: {sql_list([v])[1:-1]}" for k, v in cv.CUISINE_ALIASES.items())
_PIECES = ("list_transform(flatten(list_transform(categories, lambda c: string_split_regex(replace(replace(regexp_replace(lower(trim(c)), '^[^:]*:', ''), "
           "'catering.', ''), 'restaurant.', ''), '[;.,/]'))), lambda p: regexp_replace(replace(trim(p), ' ', '_'), '_restaurant$', ''))")
_MAPPED = f"list_filter(list_transform({_PIECES}, lambda p: coalesce(m[p], m[replace(p, '_', ' ')])), lambda v: v IS NOT NULL)"
_HINTS = "[" + ", ".join(
    f"CASE WHEN regexp_matches(lower(name), '(^|[^a-zà-ÿ0-9_]){cue}([^a-zà-ÿ0-9_]|$)') THEN '{cuisine}' END" for cue, cuisine in cv.NAME_HINTS.items()) + "]"


def _first_distinct(expr: str) -> str:
    return f"list_filter({expr}, lambda v, i: list_position({expr}, v) = i)"


CUISINES = f"(SELECT *, CASE WHEN len(mapped) > 0 THEN {_first_distinct('mapped')} ELSE {_first_distinct('hinted')} END AS cuisines FROM (SELECT *, {_MAPPED} AS mapped, list_filter({_HINTS}, lambda v: v IS NOT NULL) AS hinted FROM (SELECT *, MAP {{{_ALIASES}}} AS m FROM places)))"


@query("cuisines_for", "JN-12", with_tables(
    f"SELECT restaurant_id, array_to_string(cuisines, ',') AS cuisines FROM {CUISINES}", places=PLACES_SQL))
def cuisines_for(spark, sf_dir):
    return places(spark, sf_dir).select("restaurant_id", F.array_join(
        e.cuisines_for(F.col("categories"), F.col("name")), ",").alias("cuisines"))


_REGIONS = ["US", "TH", "IN", "GB", "JP", "unknown", "MX"]
_BASE = ("CASE WHEN len(cuisines) = 0 THEN 0.3 ELSE list_max(list_transform(cuisines, lambda c: CASE c "
         + " ".join(f"WHEN '{c}' THEN {v}" for c, v in cv.CUISINE_BASELINE.items()) + " ELSE 0.3 END)) END")
_HOME_MAP = "MAP {" + ", ".join(f"'{c}': {sql_list(v)}" for c, v in cv.CUISINE_HOME.items()) + "}"
_AT_HOME = f"len(list_filter(cuisines, lambda c: coalesce(list_contains({_HOME_MAP}[c], region), false))) > 0"


@query("cuisine_prior", "JN-10", with_tables(
    f"SELECT restaurant_id, CAST(base AS DOUBLE) AS base, round(CAST(1 AS DOUBLE) * CASE WHEN {_AT_HOME} THEN least(0.97, base * 1.25) ELSE base END, 4) AS risk, "
    f"CAST(CASE WHEN len(cuisines) = 0 THEN 0.25 ELSE 0.4 END AS DOUBLE) AS confidence FROM (SELECT *, {_BASE} AS base, {pick_sql(_REGIONS, 'k')} AS region FROM {CUISINES})",
    places=PLACES_SQL))
def cuisine_prior(spark, sf_dir):
    prior = e.cuisine_prior(e.cuisines_for(F.col("categories"), F.col("name")), pick(_REGIONS, F.col("k")))
    return places(spark, sf_dir).select("restaurant_id", prior.alias("p")).select(
        "restaurant_id", "p.base", F.round("p.risk", 4).alias("risk"), "p.confidence")


@query("generic_cuisine_prior", "JN-11", with_tables(
    "SELECT restaurant_id, round(CAST(1 AS DOUBLE) * greatest(0.3, coalesce(list_max(list_transform(cuisines, lambda c: CASE c WHEN 'italian' THEN 0.55 WHEN 'indian' THEN 0.5 END)), 0.3)) "
    f"* CASE WHEN {_AT_HOME} THEN 1.25 ELSE 1 END, 4) AS milk FROM (SELECT *, {pick_sql(_REGIONS, 'k')} AS region FROM {CUISINES})", places=PLACES_SQL))
def generic_cuisine_prior(spark, sf_dir):
    baseline = F.map_from_arrays(F.array(F.lit("_default"), F.lit("italian"), F.lit("indian")), F.array(F.lit(0.30), F.lit(0.55), F.lit(0.50)))
    risk = e.generic_cuisine_prior(e.cuisines_for(F.col("categories"), F.col("name")), pick(_REGIONS, F.col("k")), baseline)
    return places(spark, sf_dir).select("restaurant_id", F.round(risk, 4).alias("milk"))


def _scored(spark, sf_dir):
    return places(spark, sf_dir).withColumn("data_quality_score", quality_score(e.QUALITY_KINDS))


_PRESENT = {f: (f"len({f}) > 0" if f == "categories" else f"trim({f}) <> ''") for f in pv.QUALITY_FIELDS}
_QUALITY = "round((" + " + ".join(f"CAST(coalesce({c}, false) AS INT)" for c in _PRESENT.values()) + ") / CAST(7 AS DOUBLE), 3)"


@query("quality_summary", "AG-1", with_tables(
    f"SELECT count(*) AS total_rows, round(avg({_QUALITY}), 3) AS average_score, "
    + ", ".join(f"count(*) FILTER ({c}) AS with_{f}" for f, c in _PRESENT.items()) + " FROM places", places=PLACES_SQL))
def quality_summary(spark, sf_dir):
    return e.quality_summary(_scored(spark, sf_dir))


@query("source_counts", "AG-2", with_tables("SELECT source_name, count(*) AS n_rows FROM places GROUP BY 1", places=PLACES_SQL))
def source_counts(spark, sf_dir):
    return e.source_counts(places(spark, sf_dir))


@query("union_providers", "SC-4 SE-1",
       "SELECT 'geoapify' AS source_name, c_custkey AS source_key, c_name AS name, c_mktsegment AS segment FROM customer "
       "UNION ALL SELECT 'openstreetmap', s_suppkey, s_name, NULL FROM supplier")
def union_providers(spark, sf_dir):
    from dinesight.sources.places import union_providers as union
    first = table(spark, sf_dir, "customer").select(F.lit("geoapify").alias("source_name"), F.col("c_custkey").alias("source_key"),
                                                    F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    second = table(spark, sf_dir, "supplier").select(F.lit("openstreetmap").alias("source_name"), F.col("s_suppkey").alias("source_key"),
                                                     F.col("s_name").alias("name"))
    return union(first, second)


def _matched(spark, sf_dir):
    ordered = places(spark, sf_dir).withColumn("ordinal", F.col("k") * 2 + (F.col("source_name") == "openstreetmap").cast("int"))
    return e.match_entities(ordered, "ordinal")


# The greedy rule walked row by row: ``firsts`` are the first rows of a name's groups so far.
_WALK = (
    "WITH RECURSIVE places AS (" + PLACES_SQL + "), keyed AS (SELECT restaurant_id, source_name, k * 2 + CAST(source_name = 'openstreetmap' AS INT) AS ordinal, latitude, longitude, "
    "regexp_replace(lower(coalesce(name, '')), '[^a-z0-9]+', '', 'g') AS key FROM places), "
    "ordered AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ordinal) AS i FROM keyed WHERE key <> ''), "
    "walk(key, i, ordinal, group_id, firsts) AS (SELECT key, i, ordinal, ordinal, [{'o': ordinal, 'lat': latitude, 'lon': longitude}] FROM ordered WHERE i = 1 UNION ALL "
    "SELECT key, i, ordinal, coalesce(near[1].o, ordinal), CASE WHEN len(near) = 0 THEN list_append(firsts, {'o': ordinal, 'lat': latitude, 'lon': longitude}) ELSE firsts END FROM ("
    "SELECT o.key, o.i, o.ordinal, o.latitude, o.longitude, w.firsts, list_filter(w.firsts, lambda f: " + dist_sql("f.lat", "f.lon", "o.latitude", "o.longitude") + " <= 75) AS near "
    "FROM walk w JOIN ordered o ON o.key = w.key AND o.i = w.i + 1)), "
    "grouped AS (SELECT restaurant_id, source_name, k.ordinal, coalesce(w.group_id, k.ordinal) AS group_id FROM keyed k LEFT JOIN walk w ON w.ordinal = k.ordinal) ")


@query("match_entities", "JN-1", _WALK + "SELECT restaurant_id, ordinal, group_id FROM grouped")
def match_entities(spark, sf_dir):
    return _matched(spark, sf_dir).select("restaurant_id", "ordinal", "group_id")


@query("source_coverage", "AG-3", _WALK + ", sets AS (SELECT group_id, bool_or(source_name = 'geoapify') AS geoapify, bool_or(source_name = 'openstreetmap') AS openstreetmap FROM grouped GROUP BY 1), "
       "total AS (SELECT count(*) AS n_groups, count(*) FILTER (geoapify AND openstreetmap) AS matched_in_all, count(*) FILTER (NOT (geoapify AND openstreetmap)) AS not_in_all, "
       "count(*) FILTER (geoapify AND NOT openstreetmap) AS g, count(*) FILTER (openstreetmap AND NOT geoapify) AS o FROM sets) "
       "SELECT n_groups, matched_in_all, not_in_all, 'geoapify' AS source_name, g AS only_here, o AS missing_here FROM total UNION ALL SELECT n_groups, matched_in_all, not_in_all, 'openstreetmap', o, g FROM total")
def source_coverage(spark, sf_dir):
    return e.source_coverage(_matched(spark, sf_dir).select("group_id", "source_name"), ["geoapify", "openstreetmap"])


@query("nearby", "JN-2", with_tables(
    "SELECT * FROM (SELECT o.restaurant_id AS origin_id, p.restaurant_id, round(" + dist_sql("o.latitude", "o.longitude", "p.latitude", "p.longitude")
    + ", 3) AS distance_m FROM places o, places p WHERE o.source_name = 'openstreetmap' AND p.source_name = 'geoapify' AND "
    + dist_sql("o.latitude", "o.longitude", "p.latitude", "p.longitude") + " <= 400)", places=PLACES_SQL))
def nearby(spark, sf_dir):
    rows = places(spark, sf_dir)
    origins = rows.where("source_name = 'openstreetmap'").select(F.col("restaurant_id").alias("origin_id"), "latitude", "longitude")
    found = e.nearby(origins, rows.where("source_name = 'geoapify'").select("restaurant_id", "latitude", "longitude"), 400.0)
    return found.select("origin_id", "restaurant_id", F.round("distance_m", 3).alias("distance_m"))


_FROM_CENTRE = dist_sql("latitude", "longitude", "37.02", "-121.98")


@query("within_radius", "FI-2", with_tables(
    f"SELECT restaurant_id FROM places WHERE {_FROM_CENTRE} <= 1500", places=PLACES_SQL))
def within_radius(spark, sf_dir):
    return places(spark, sf_dir).where(e.within_radius(F.col("latitude"), F.col("longitude"), (37.02, -121.98), 1500.0)).select("restaurant_id")


@query("nearest", "SO-1", with_tables(
    f"SELECT restaurant_id, round({_FROM_CENTRE}, 2) AS distance_m FROM places ORDER BY {_FROM_CENTRE}, restaurant_id LIMIT 25", places=PLACES_SQL))
def nearest(spark, sf_dir):
    return e.nearest(places(spark, sf_dir), (37.02, -121.98), 25).select("restaurant_id", F.round("distance_m", 2).alias("distance_m"))


@query("deep_top_n", "WI-9", with_tables(
    "SELECT restaurant_id, source_name, row_number() OVER (PARTITION BY source_name ORDER BY round(" + _FROM_CENTRE
    + ", 3), restaurant_id) <= 12 AS deep FROM places", places=PLACES_SQL))
def deep_top_n(spark, sf_dir):
    rows = places(spark, sf_dir).withColumn("distance_m", F.round(geo.haversine_m(
        F.col("latitude"), F.col("longitude"), F.lit(37.02), F.lit(-121.98)), 3))
    return e.deep_top_n(rows, ["source_name"]).select("restaurant_id", "source_name", "deep")


_KINDS = ["city", "administrative", "cafe", "village"]
_CATS = ["place", "boundary", "amenity"]


@query("geocode_best_place", "WI-12",
       "SELECT query_id, result_ord FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN cat = 'place' AND kind IN ('city', 'village') "
       "OR cat = 'boundary' AND kind = 'administrative' THEN 1 ELSE 0 END DESC, c_acctbal DESC, result_ord) AS rn FROM (SELECT c_nationkey AS query_id, "
       f"c_custkey AS result_ord, c_acctbal, {pick_sql(_CATS, 'c_custkey')} AS cat, {pick_sql(_KINDS, 'c_custkey')} AS kind FROM customer)) WHERE rn = 1")
def geocode_best_place(spark, sf_dir):
    k = F.col("c_custkey")
    results = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("query_id"), k.alias("result_ord"), F.col("c_acctbal").alias("importance"),
        pick(_CATS, k).alias("category"), pick(_KINDS, k).alias("type"))
    return e.geocode_best_place(results).select("query_id", "result_ord")


def registry(spark, sf_dir):
    """Verified kitchens, one per nation of the given tables."""
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        n.alias("entry_ord"), F.concat(pick(["Golden ", "Blue ", "Thai", "Zzz "], n), pick(["Kitchen", "Garden", "", "House"], n)).alias("name"),
        pick(["", "cupertino", "london"], n).alias("city"), F.when(n % 5 == 0, F.lit("thaigarden.com")).otherwise("").alias("domain"),
        (n % 2 == 0).alias("nut_free"), (n % 3 == 0).alias("allergy_dedicated"))


REGISTRY_SQL = (
    f"SELECT n_nationkey AS entry_ord, {pick_sql(['Golden ', 'Blue ', 'Thai', 'Zzz '], 'n_nationkey')} || {pick_sql(['Kitchen', 'Garden', '', 'House'], 'n_nationkey')} AS name, "
    f"{pick_sql(['', 'cupertino', 'london'], 'n_nationkey')} AS city, CASE WHEN n_nationkey % 5 = 0 THEN 'thaigarden.com' ELSE '' END AS domain, "
    "n_nationkey % 2 = 0 AS nut_free, n_nationkey % 3 = 0 AS allergy_dedicated FROM nation")
_LOOKUP = (
    "SELECT p.restaurant_id, min(r.entry_ord) AS entry_ord FROM places p LEFT JOIN registry r ON "
    "(r.domain <> '' AND p.website_url IS NOT NULL AND (" + domain_sql("p.website_url") + " = r.domain OR ends_with(" + domain_sql("p.website_url")
    + ", '.' || r.domain))) OR (contains(regexp_replace(lower(coalesce(p.name, '')), '[^a-z0-9]+', '', 'g'), regexp_replace(lower(r.name), '[^a-z0-9]+', '', 'g')) "
    "AND (r.city = '' OR contains(lower(coalesce(p.address, '')), r.city))) GROUP BY 1")


@query("lookup_registry", "JN-3", with_tables(_LOOKUP, places=PLACES_SQL, registry=REGISTRY_SQL))
def lookup_registry(spark, sf_dir):
    return e.lookup_registry(places(spark, sf_dir), registry(spark, sf_dir)).select("restaurant_id", "entry_ord")


@query("registry_signals", "RS-14", with_tables(
    "SELECT p.restaurant_id, p.k % 7 = 0 OR coalesce(r.nut_free, false) AS nut_free_claim, p.k % 11 = 0 OR coalesce(r.allergy_dedicated, false) AS allergy_disclaimer "
    f"FROM places p JOIN ({_LOOKUP}) m ON p.restaurant_id = m.restaurant_id LEFT JOIN registry r ON r.entry_ord = m.entry_ord",
    places=PLACES_SQL, registry=REGISTRY_SQL))
def registry_signals(spark, sf_dir):
    reg = registry(spark, sf_dir)
    matched = e.lookup_registry(places(spark, sf_dir), reg).withColumn("nut_free_claim", F.col("k") % 7 == 0).withColumn(
        "allergy_disclaimer", F.col("k") % 11 == 0)
    return e.registry_signals(matched, reg).select("restaurant_id", "nut_free_claim", "allergy_disclaimer")


def _name_tables(spark, sf_dir):
    rows = places(spark, sf_dir).select(F.col("restaurant_id").alias("row_id"), "name", F.round(geo.haversine_m(
        F.col("latitude"), F.col("longitude"), F.lit(37.02), F.lit(-121.98)), 3).alias("distance_m"))
    n = F.col("n_nationkey")
    queries = table(spark, sf_dir, "nation").select(n.alias("query_id"), F.concat(
        pick(["golden", "Blue Diner", "Royal Kitchen Annex", "den", "Sushi House"], n), pick(["", " kitchen", "!"], n)).alias("query"))
    return rows, queries


_MATCHES = (
    f"(SELECT * FROM (SELECT r.row_id, q.query_id, r.distance_m, CASE WHEN rk = qk THEN 1 WHEN starts_with(rk, qk) OR starts_with(qk, rk) THEN 2 ELSE 3 END AS tier, rk, qk "
    f"FROM (SELECT restaurant_id AS row_id, regexp_replace(lower(coalesce(name, '')), '[^a-z0-9]+', '', 'g') AS rk, round({_FROM_CENTRE}, 3) AS distance_m FROM places) r, "
    f"(SELECT n_nationkey AS query_id, regexp_replace(lower({pick_sql(['golden', 'Blue Diner', 'Royal Kitchen Annex', 'den', 'Sushi House'], 'n_nationkey')} || "
    f"{pick_sql(['', ' kitchen', '!'], 'n_nationkey')}), '[^a-z0-9]+', '', 'g') AS qk FROM nation) q) WHERE rk <> '' AND (contains(rk, qk) OR contains(qk, rk)))")


@query("best_name_match", "JN-19", with_tables(
    f"SELECT query_id, row_id, CAST(tier AS INTEGER) AS tier FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, distance_m, row_id) AS rn FROM {_MATCHES}) WHERE rn = 1",
    places=PLACES_SQL))
def best_name_match(spark, sf_dir):
    return e.best_name_match(*_name_tables(spark, sf_dir)).select("query_id", "row_id", "tier")


@query("name_candidates", "JN-20", with_tables(
    f"SELECT query_id, row_id, CAST(rn AS INTEGER) AS position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance_m, row_id) AS rn FROM {_MATCHES}) WHERE rn <= 5",
    places=PLACES_SQL))
def name_candidates(spark, sf_dir):
    return e.name_candidates(*_name_tables(spark, sf_dir), 5).select("query_id", "row_id", "position")




# --- Provider dumps: places written as each provider would, some of them broken, and read again ------------
_ORIGIN = (37.02, -121.98)
_OUT_COLUMNS = ["source_id", "name", "address", "latitude", "longitude", "distance_meters", "website_url", "phone_number", "opening_hours", "business_status", "source_last_updated"]


def _dumps(rows, field, record):
    """One dump per place: every 17th cut short, every 18th with a record that is no object."""
    body = F.to_json(F.struct(F.array(record).alias(field), F.lit("2026-01-01").alias("fetched_at")))
    k = F.col("k")
    broken = F.when(k % 17 == 0, F.substring(body, 1, 40)).when(k % 18 == 0, F.concat(F.lit('{"' + field + '":[7],"fetched_at":""}'))).otherwise(body)
    return rows.select(F.col("restaurant_id").alias("file_path"), broken.alias("body"))


def _osm_dumps(spark, sf_dir):
    k = F.col("k")
    tags = F.create_map(*[x for name, value in (
        ("name", F.col("name")), ("addr:street", F.col("address")), ("cuisine", pick(["thai", "", "pizza"], k)), ("website", F.when(k % 2 == 0, F.col("website_url"))),
        ("contact:website", F.col("website_url")), ("phone", F.col("phone_number")), ("opening_hours", F.col("opening_hours")), ("amenity", pick(["restaurant", "cafe", "bank"], k)),
        ("disused:amenity", F.when(k % 29 == 0, "restaurant")), ("check_date", F.col("source_last_updated"))) for x in (F.lit(name), value)])
    none = F.lit(None).cast("double")
    lat, lon = F.col("latitude"), F.col("longitude")
    own, away = k % 19 != 0, k % 23 != 0
    record = F.struct(F.lit("node").alias("type"), k.alias("id"), F.when(own & away, lat).otherwise(none).alias("lat"), F.when(own & away, lon).otherwise(none).alias("lon"),
                      F.when(~own & away, F.struct(lat.alias("lat"), lon.alias("lon"))).alias("center"), tags.alias("tags"))
    return _dumps(places(spark, sf_dir), "elements", record)


_READ = "k % 17 <> 0 AND k % 18 <> 0 AND k % 23 <> 0"
_AWAY = "round(" + dist_sql(str(_ORIGIN[0]), str(_ORIGIN[1]), "latitude", "longitude") + ", 1)"


@query("places_from_osm", "SC-1", with_tables(
    f"SELECT 'node/' || k AS source_id, name, address, latitude, longitude, {_AWAY} AS distance_meters, website_url, phone_number, opening_hours, "
    "CASE WHEN k % 29 = 0 THEN 'closed_or_inactive' WHEN k % 3 <> 2 THEN 'presumed_operational' END AS business_status, source_last_updated, "
    f"'amenity:' || {pick_sql(['restaurant', 'cafe', 'bank'], 'k')} || {pick_sql([';cuisine:thai', '', ';cuisine:pizza'], 'k')} AS categories FROM places WHERE {_READ}", places=PLACES_SQL))
def places_from_osm(spark, sf_dir):
    rows, _ = sources.places_from_osm(_osm_dumps(spark, sf_dir), _ORIGIN)
    return rows.select(*_OUT_COLUMNS, F.array_join("categories", ";").alias("categories"))


def _geoapify_dumps(spark, sf_dir):
    k = F.col("k")
    raw = F.create_map(F.lit("website"), F.when(k % 3 == 2, F.col("website_url")), F.lit("phone"), F.col("phone_number"), F.lit("takeaway"), pick(["yes", "no", "maybe"], k),
                       F.lit("osm_type"), F.lit("way"), F.lit("osm_id"), k.cast("string"), F.lit("check_date"), F.col("source_last_updated"), F.lit("disused:amenity"), F.when(k % 29 == 0, "cafe"))
    properties = F.struct("name", F.col("address").alias("formatted"), ((k % 500) * 1.37).alias("distance"), F.col("categories"), F.when(k % 3 == 0, F.col("website_url")).alias("website"),
                          F.when(k % 2 == 0, k.cast("string")).alias("place_id"), F.struct(F.when(k % 3 == 1, F.col("website_url")).alias("website")).alias("contact"),
                          F.col("opening_hours"), F.struct(raw.alias("raw")).alias("datasource"))
    point = F.when(k % 23 != 0, F.array("longitude", "latitude")).otherwise(F.array("longitude"))
    return _dumps(places(spark, sf_dir), "features", F.struct(F.struct(point.alias("coordinates")).alias("geometry"), properties.alias("properties")))


@query("places_from_geoapify", "SC-2", with_tables(
    "SELECT CASE WHEN k % 2 = 0 THEN CAST(k AS VARCHAR) ELSE 'way/' || k END AS source_id, name, address, latitude, longitude, round((k % 500) * 1.37::DOUBLE, 1) AS distance_meters, website_url, phone_number, opening_hours, "
    "CASE WHEN k % 29 = 0 THEN 'closed_or_inactive' ELSE 'presumed_operational' END AS business_status, nullif(trim(source_last_updated), '') AS source_last_updated, "
    f"CASE k % 3 WHEN 0 THEN true WHEN 1 THEN false END AS takeout FROM places WHERE {_READ}", places=PLACES_SQL))
def places_from_geoapify(spark, sf_dir):
    rows, _ = sources.places_from_geoapify(_geoapify_dumps(spark, sf_dir))
    return rows.select(*_OUT_COLUMNS, F.try_element_at("service_options", F.lit("takeout")).alias("takeout"))


def _google_dumps(spark, sf_dir):
    k = F.col("k")
    hours = F.struct(F.when(F.col("opening_hours").isNotNull(), F.array("opening_hours", F.lit("Mon: closed"))).alias("weekdayDescriptions"), (k % 2 == 0).alias("openNow"))
    record = F.struct(k.cast("string").alias("id"), F.struct(F.col("name").alias("text")).alias("displayName"), F.col("address").alias("formattedAddress"),
                      F.when(k % 23 != 0, F.struct("latitude", "longitude")).alias("location"), (k % 5 + 0.5).alias("rating"), (k % 900).cast("int").alias("userRatingCount"),
                      F.when(k % 2 == 0, "cafe").alias("primaryType"), F.array(F.lit("food"), F.lit("bar")).alias("types"), F.col("website_url").alias("websiteUri"),
                      F.when(k % 4 == 0, F.col("phone_number")).alias("nationalPhoneNumber"), F.col("phone_number").alias("internationalPhoneNumber"), F.lit("OPERATIONAL").alias("businessStatus"),
                      F.when(k % 3 == 0, hours).alias("currentOpeningHours"), hours.alias("regularOpeningHours"), F.when(k % 2 == 0, k % 4 == 0).alias("delivery"))
    return _dumps(places(spark, sf_dir), "places", record)


@query("places_from_google", "SC-3", with_tables(
    f"SELECT CAST(k AS VARCHAR) AS source_id, name, address, latitude, longitude, {_AWAY} AS distance_meters, website_url, phone_number, opening_hours || '; Mon: closed' AS opening_hours, 'OPERATIONAL' AS business_status, "
    "CAST(NULL AS VARCHAR) AS source_last_updated, (k % 5 + 0.5)::DOUBLE AS rating, CAST(k % 900 AS INTEGER) AS review_count, k % 2 = 0 AS is_open_now, CASE WHEN k % 2 = 0 THEN k % 4 = 0 END AS delivery, "
    f"CASE WHEN k % 2 = 0 THEN 'primary_type:cafe;' ELSE '' END || 'food;bar' AS categories FROM places WHERE {_READ}", places=PLACES_SQL))
def places_from_google(spark, sf_dir):
    rows, _ = sources.places_from_google(_google_dumps(spark, sf_dir), _ORIGIN)
    return rows.select(*_OUT_COLUMNS, "rating", "review_count", "is_open_now", F.try_element_at("service_options", F.lit("delivery")).alias("delivery"), F.array_join("categories", ";").alias("categories"))


@query("unreadable_places", "SC-1 SC-2 SC-3", with_tables(
    "SELECT provider, restaurant_id AS file_path, CASE WHEN k % 17 = 0 THEN 'unreadable dump' WHEN k % 18 = 0 THEN 'not an object' ELSE 'no coordinates' END AS reason "
    f"FROM places, (SELECT unnest(['osm', 'geoapify', 'google']) AS provider) WHERE NOT ({_READ})", places=PLACES_SQL))
def unreadable_places(spark, sf_dir):
    found = {"osm": sources.places_from_osm(_osm_dumps(spark, sf_dir), _ORIGIN), "geoapify": sources.places_from_geoapify(_geoapify_dumps(spark, sf_dir)),
             "google": sources.places_from_google(_google_dumps(spark, sf_dir), _ORIGIN)}
    parts = [rejected.select(F.lit(name).alias("provider"), "file_path", "reason") for name, (_, rejected) in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
