"""URL typing, scoring, recency and provenance of candidate sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from dinesight.catalog import query
from dinesight.catalog.tables import LINKS_SQL, PLACES_SQL, links, places, sql_list, table, with_tables
from dinesight.functions import urls as u
from dinesight.vocab import places as pv
from dinesight.vocab import web

NETLOC = r"regexp_extract(coalesce({0}, ''), '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1)"
PATH = r"regexp_extract(coalesce({0}, ''), '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"
QUERY = r"regexp_extract(coalesce({0}, ''), '^[^?#]*\?([^#]*)', 1)"
HOST = rf"regexp_replace(regexp_replace(lower({NETLOC}), ':.*$', ''), '^www\.', '')"
BARE = r"regexp_replace(lower({0}), '[?#].*$', '')"


def any_sql(expr: str, values: list[str]) -> str:
    return f"len(list_filter({sql_list(values)}, lambda v: contains({expr}, v))) > 0"


def ends_sql(expr: str, values: list[str]) -> str:
    return f"len(list_filter({sql_list(values)}, lambda v: ends_with({expr}, v))) > 0"


def map_sql(expr: str, table_: dict) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {sql_list([k])[1:-1]} THEN {sql_list([v])[1:-1]}" for k, v in table_.items()) + " END"


_LABELS = f"list_filter(string_split({HOST}, '.'), lambda s: length(s) > 0)"
DOMAIN = ("CASE WHEN len({l}) <= 2 THEN array_to_string({l}, '.') WHEN list_contains(" + sql_list(web.TWO_LEVEL_TLDS)
          + ", array_to_string({l}[-2:], '.')) THEN array_to_string({l}[-3:], '.') ELSE array_to_string({l}[-2:], '.') END")


def domain_sql(expr: str) -> str:
    return DOMAIN.format(l=_LABELS.format(expr))


def host_country_sql(host_expr: str) -> str:
    return map_sql(rf"regexp_extract(regexp_replace(lower({host_expr}), ':.*$', ''), '\.([^.]*)$', 1)", pv.CCTLD)


SOURCE_TYPE = (
    "CASE WHEN ends_with(lower({p}), '.pdf') THEN 'pdf' WHEN {img} THEN 'image' "
    "WHEN {host} OR contains(lower(url || ' ' || anchor), 'order') THEN 'ordering_page' "
    "WHEN contains(lower(url || ' ' || anchor), 'allergen') OR contains(lower(url || ' ' || anchor), 'nutrition') "
    "THEN 'nutrition_or_allergen_page' ELSE 'website_link' END").format(
        p=PATH.format("url"), img=ends_sql(f"lower({PATH.format('url')})", web.IMAGE_EXTENSIONS),
        host=any_sql(f"lower({NETLOC.format('url')})", web.ORDERING_HOSTS))
_SIGNAL = f"lower({PATH.format('url')} || ' ' || {QUERY.format('url')} || ' ' || anchor)"


@query("url_parts", "PR-8 PR-9 PR-10",
       "SELECT page_id, " + HOST.format("url") + " AS host, " + PATH.format("url") + " AS path, " + domain_sql("url")
       + " AS domain, regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') AS canonical, " + HOST.format("url")
       + " || regexp_replace(" + PATH.format("url") + ", '/+$', '') AS cache_key, ends_with(" + BARE.format("url")
       + ", '.pdf') AS is_pdf FROM pages")
def url_parts(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", u.host(url).alias("host"), u.url_path(url).alias("path"), u.registrable_domain(u.netloc(url)).alias("domain"),
        u.canonical_url(url).alias("canonical"), u.cache_url(url).alias("cache_key"), u.is_pdf_url(url).alias("is_pdf"))


@query("source_type", "PR-11", with_tables(
    f"SELECT link_id, {SOURCE_TYPE} AS source_type, {SOURCE_TYPE} IN ('pdf', 'nutrition_or_allergen_page') OR "
    f"{any_sql(_SIGNAL, web.STRICT_MENU_WORDS)} AS is_primary FROM links", links=LINKS_SQL))
def source_type(spark, sf_dir):
    url, text = F.col("url"), F.col("anchor")
    return links(spark, sf_dir).select("link_id", u.source_type(url, text).alias("source_type"),
                                       u.is_primary_candidate(url, text).alias("is_primary"))


GRADE_SQL = (
    "CASE WHEN {s} = 'validated' AND {t} IN ('website_link', 'pdf', 'nutrition_or_allergen_page', 'schema_org_menu') THEN 'A' "
    "WHEN {t} = 'ordering_page' AND {c} >= 0.35 THEN 'B' WHEN {t} = 'image' THEN 'C' WHEN {s} = 'not_fetchable' THEN 'F' "
    "WHEN {c} >= 0.6 THEN 'B' WHEN {c} >= 0.3 THEN 'C' ELSE 'D' END")


@query("evidence_grade", "PR-12 PR-13", with_tables(
    "SELECT link_id, " + GRADE_SQL.format(s="validation_status", t="st", c="confidence") + " AS grade, "
    "round(greatest(0, least(1, confidence - 0.2)), 4) AS lowered, "
    + GRADE_SQL.format(s="'rejected'", t="st", c="greatest(0, least(1, confidence - 0.2))") + " AS regrade "
    f"FROM (SELECT *, {SOURCE_TYPE} AS st FROM links)", links=LINKS_SQL))
def evidence_grade(spark, sf_dir):
    kind = u.source_type(F.col("url"), F.col("anchor"))
    lowered = u.validation_delta(F.col("confidence"), F.lit(-0.2))
    return links(spark, sf_dir).select(
        "link_id", u.evidence_grade(F.col("confidence"), F.col("validation_status"), kind).alias("grade"),
        F.round(lowered, 4).alias("lowered"), u.evidence_grade(lowered, F.lit("rejected"), kind).alias("regrade"))


_STRICT = f"list_filter({sql_list(web.STRICT_MENU_WORDS)}, lambda v: contains(hay, v))"
_SECOND = f"list_filter({sql_list(web.SECONDARY_MENU_WORDS)}, lambda v: contains(hay, v))"
_HINT_WORDS = "list_filter(string_split_regex(lower(address), '[^a-z0-9]+'), lambda w: length(w) >= 4)"
CANDIDATE_SCORE = (
    "least(len(s1) * 0.2, 0.7) + least(len(s2) * 0.08, 0.25) + CASE WHEN ends_with(path, '.pdf') THEN 0.35 ELSE 0 END + "
    f"CASE WHEN {any_sql('loc', web.ORDERING_HOSTS)} THEN 0.35 ELSE 0 END + CASE WHEN regexp_matches(path, '/menu/?$') THEN 0.25 ELSE 0 END "
    "+ CASE WHEN len(list_filter(hint, lambda w: contains(path, w))) > 0 THEN 0.2 "
    f"WHEN {any_sql('path', web.LOCATION_PATH_WORDS)} THEN -0.15 ELSE 0 END")
SCORED_LINKS = (f"(SELECT *, {_STRICT} AS s1, {_SECOND} AS s2 FROM (SELECT *, {_SIGNAL} AS hay, lower({PATH.format('url')}) AS path, "
                f"lower({NETLOC.format('url')}) AS loc, {_HINT_WORDS} AS hint FROM links))")


@query("score_source_candidate", "PR-14", with_tables(
    f"SELECT link_id, round(CAST({CANDIDATE_SCORE} AS DOUBLE), 4) AS score, array_to_string(list_filter(["
    "CASE WHEN len(s1) > 0 THEN 'says it is a menu: ' || array_to_string(s1[1:5], ', ') END, "
    "CASE WHEN len(s2) > 0 THEN 'food words: ' || array_to_string(s2[1:5], ', ') END, "
    "CASE WHEN ends_with(path, '.pdf') THEN 'is a PDF' END, "
    f"CASE WHEN {any_sql('loc', web.ORDERING_HOSTS)} THEN 'host of a menu or ordering service' END, "
    "CASE WHEN regexp_matches(path, '/menu/?$') THEN 'address ends in menu' END, "
    "CASE WHEN len(list_filter(hint, lambda w: contains(path, w))) > 0 THEN 'names the place asked for: ' || address "
    f"WHEN {any_sql('path', web.LOCATION_PATH_WORDS)} THEN 'names some other branch' END"
    f"], lambda v: v IS NOT NULL), '; ') AS reasons FROM {SCORED_LINKS}", links=LINKS_SQL))
def score_source_candidate(spark, sf_dir):
    scored = u.score_source_candidate(F.col("url"), F.col("anchor"), F.col("address"))
    return links(spark, sf_dir).select("link_id", scored.alias("s")).select(
        "link_id", F.round("s.score", 4).alias("score"), F.array_join("s.reasons", "; ").alias("reasons"))


_YEARS = "list_transform(regexp_extract_all({0}, '{1}', {2}), lambda y: CAST(y AS DOUBLE))"
RECENCY = (
    "greatest(coalesce(CAST(nullif(regexp_extract(b, '/(20[0-3][0-9])/(0[1-9]|1[0-2])/', 1), '') AS DOUBLE) + "
    "CAST(nullif(regexp_extract(b, '/(20[0-3][0-9])/(0[1-9]|1[0-2])/', 2), '') AS DOUBLE) / 12, 0), "
    "coalesce(list_max(list_transform(regexp_extract_all(b, '20[0-3][0-9][-_]20[0-3][0-9]'), "
    "lambda s: greatest(CAST(s[1:4] AS DOUBLE), CAST(s[6:9] AS DOUBLE)))), 0), "
    "coalesce(list_max(list_transform(list_filter(regexp_extract_all(b, '[0-9]+'), "
    "lambda d: regexp_full_match(d, '20[0-3][0-9](0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])')), "
    "lambda d: CAST(d[1:4] AS DOUBLE) + CAST(d[5:6] AS DOUBLE) / 12)), 0), "
    "coalesce(list_max(list_transform(list_filter(regexp_extract_all(regexp_extract(b, '[^/]*$', 0), '[0-9]+'), "
    "lambda d: regexp_full_match(d, '(0[1-9]|1[0-2])([0-2][0-9]|3[01])[0-9][0-9]')), "
    "lambda d: 2000 + CAST(d[5:6] AS DOUBLE) + CAST(d[1:2] AS DOUBLE) / 12)), 0), "
    "coalesce(list_max(list_transform(list_filter(regexp_extract_all(b, '[0-9]+'), "
    "lambda d: regexp_full_match(d, '20[0-3][0-9]')), lambda d: CAST(d AS DOUBLE))), 0))")
DUPLICATE_KEY = ("regexp_replace(lower(" + NETLOC.format("url") + r"), '^www\.', '') || '|' || trim(regexp_replace(regexp_replace("
                 r"regexp_replace(regexp_extract(lower(" + PATH.format("url") + r"), '[^/]*$', 0), '\.pdf$', ''), "
                 "'20[0-3][0-9][-_]?20[0-3][0-9]|[0-9]{2,8}', ' ', 'g'), '[^a-z]+', ' ', 'g'))")


@query("source_recency", "PR-17 PR-18", with_tables(
    f"SELECT link_id, round({RECENCY}, 4) AS recency, {DUPLICATE_KEY} AS duplicate_key "
    f"FROM (SELECT *, {BARE.format('url')} AS b FROM links)", links=LINKS_SQL))
def source_recency(spark, sf_dir):
    return links(spark, sf_dir).select("link_id", F.round(u.source_recency(F.col("url")), 4).alias("recency"),
                                       u.dated_duplicate_key(F.col("url")).alias("duplicate_key"))


_LAST = "lower(list_filter(list_transform(string_split(coalesce(address, ''), ','), lambda p: trim(p)), lambda p: length(p) > 0)[-1])"
HOME_SQL = (f"coalesce({map_sql(_LAST, pv.HOME_NAMES)}, CASE WHEN regexp_matches(coalesce(address, ''), "
            r"'\b[A-Z]{2}\s+[0-9]{5}(-[0-9]{4})?\b') THEN 'US' END, " + host_country_sql(NETLOC.format("website_url")) + ")")


@query("home_country", "PR-19 PR-20 PR-40", with_tables(
    "SELECT restaurant_id, site, home, coalesce(" + map_sql("home", pv.COUNTRY_LABEL) + ", coalesce(home, '')) AS label, coalesce("
    + map_sql("home", pv.REGION_TOKEN) + f", '') AS token FROM (SELECT restaurant_id, {host_country_sql(NETLOC.format('website_url'))} AS site, "
    f"{HOME_SQL} AS home FROM places)", places=PLACES_SQL))
def home_country(spark, sf_dir):
    home = u.home_country(F.col("address"), F.col("website_url"))
    return places(spark, sf_dir).select(
        "restaurant_id", u.host_country(u.netloc(F.col("website_url"))).alias("site"), home.alias("home"),
        u.country_label(home).alias("label"), u.region_token(home).alias("token"))


@query("foreign_source", "FI-4 WI-6", with_tables(
    "SELECT link_id, coalesce(cc <> home, false) AS is_foreign, CAST(CASE WHEN dom = 'goldendiner.com' THEN 0 WHEN cc = home THEN 1 "
    "WHEN cc <> home THEN 3 ELSE 2 END AS INTEGER) AS provenance "
    f"FROM (SELECT *, {host_country_sql(NETLOC.format('url'))} AS cc, {domain_sql('url')} AS dom FROM links)", links=LINKS_SQL))
def foreign_source(spark, sf_dir):
    url, home = F.col("url"), F.col("home")
    return links(spark, sf_dir).select(
        "link_id", u.is_foreign_source(url, home).alias("is_foreign"),
        u.provenance_rank(url, F.lit("goldendiner.com"), home).alias("provenance"))


_PARTS = "list_filter(list_transform(string_split(coalesce({0}, ''), ','), lambda p: trim(p)), lambda p: length(p) > 0)"
CITY_SQL = ("CASE WHEN len({p}) >= 3 THEN trim(regexp_replace(lower({p}[2]), '[^a-z0-9]+', '-', 'g'), '-') "
            "WHEN len({p}) = 2 THEN trim(regexp_replace(lower({p}[1]), '[^a-z0-9]+', '-', 'g'), '-') END").format(p=_PARTS.format("address"))


def _rest_sql(text: str) -> str:
    return (f"list_filter(string_split_regex(lower({text}), '[^a-z0-9]+'), lambda t: length(t) > 0 AND NOT list_contains("
            f"list_concat({sql_list(pv.NON_CITY_TOKENS)}, string_split_regex(lower(name), '[^a-z0-9]+')), t) "
            "AND NOT regexp_full_match(t, '[0-9]+'))")


_MISMATCH = ("coalesce(city <> '' AND NOT url_has AND shown IS NOT NULL AND shown <> city, false)")
CITY_FACTS = (
    "(SELECT *, city IS NOT NULL AND city <> '' AND len(list_filter(string_split(city, '-'), lambda t: NOT list_contains("
    "string_split_regex(lower(" + PATH.format("url") + r"), '\W+'), t))) = 0 AS url_has, "
    "CASE WHEN len(rest) BETWEEN 1 AND 3 THEN array_to_string(rest, '-') END AS shown "
    f"FROM (SELECT *, {CITY_SQL} AS city, {_rest_sql(PATH.format('url'))} AS rest FROM links))")


@query("city_facts", "PR-22 PR-23", with_tables(
    f"SELECT link_id, city, coalesce(url_has, false) AS url_has_city, shown, {_MISMATCH} AS mismatch FROM {CITY_FACTS}", links=LINKS_SQL))
def city_facts(spark, sf_dir):
    url, address, name = F.col("url"), F.col("address"), F.col("name")
    city = u.city_from_address(address)
    return links(spark, sf_dir).select(
        "link_id", city.alias("city"), u.url_has_city(url, city).alias("url_has_city"),
        u.source_city_slug(url, name).alias("shown"), u.menu_city_mismatch(url, address, name).alias("mismatch"))


_PRINTED = ["Visit us: 12 High St, Interlochen, United States", "9 Elm Rd, Springfield, IL 62704", "Find us in Cupertino",
            "No address at all", "Menu, Salem, Oregon"]


def _declared(pattern: str) -> str:
    return (f"len(list_filter(regexp_extract_all(low, '{pattern}', 1), lambda seg: len(" + _rest_sql("seg") + ") BETWEEN 1 AND 3 AND "
            "len(list_filter(" + _rest_sql("seg") + ", lambda t: length(t) >= 3)) > 0 AND array_to_string(" + _rest_sql("seg") + ", '-') <> city)) > 0")


@query("text_locality_contradiction", "PR-24", with_tables(
    "SELECT link_id, coalesce(city <> '' AND NOT regexp_matches(low, '\\b' || replace(city, '-', '[\\W_]+') || '\\b') AND ("
    + _declared(r"([^,]{1,40}),\s*(?:" + "|".join(sorted(pv.ADDRESS_COUNTRIES, key=len, reverse=True)) + r")\b") + " OR "
    + _declared(r"([^,]{1,40}),\s*(?:" + "|".join(c.lower() for c in pv.US_STATE_CODES) + r")\s+[0-9]{5}\b")
    + "), false) AS contradicts FROM (SELECT *, lower(trim(regexp_replace(body, '\\s+', ' ', 'g'))) AS low FROM "
    f"(SELECT *, list_extract({sql_list(_PRINTED)}, CAST(link_id % {len(_PRINTED)} AS INTEGER) + 1) AS body, {CITY_SQL} AS city FROM links))",
    links=LINKS_SQL))
def text_locality_contradiction(spark, sf_dir):
    from dinesight.catalog.tables import pick
    return links(spark, sf_dir).select("link_id", u.text_locality_contradiction(
        pick(_PRINTED, F.col("link_id")), F.col("address"), F.col("name")).alias("contradicts"))


@query("source_trust", "PR-28", with_tables(
    "SELECT link_id, round(CAST(1 AS DOUBLE) * CASE WHEN h = 'goldendiner.com' THEN 1.0 ELSE 0.7 END * CASE WHEN y IS NULL THEN 0.9 WHEN 2026 - y <= 3 THEN 1.0 "
    "ELSE greatest(0.5, 1.0 - 0.12 * (2026 - y - 3)) END, 4) AS trust FROM (SELECT link_id, " + HOST.format("url") + " AS h, "
    "list_max(list_filter(list_transform(regexp_extract_all(url, '(19|20)[0-9]{2}'), lambda y: CAST(y AS INTEGER)), "
    "lambda y: y BETWEEN 2000 AND 2026)) AS y FROM links)", links=LINKS_SQL))
def source_trust(spark, sf_dir):
    return links(spark, sf_dir).select("link_id", F.round(
        u.source_trust(F.col("url"), F.lit("goldendiner.com"), 2026), 4).alias("trust"))


@query("labeling_trust", "PR-29",
       f"SELECT c_custkey, CASE WHEN r IN ({', '.join(repr(c) for c in pv.HIGH_LABELING_REGIONS)}) THEN CAST(0.7 AS DOUBLE) ELSE 0.35 END AS trust, "
       f"CASE WHEN r IN ({', '.join(repr(c) for c in pv.MANDATE_REGIONS)}) THEN CAST(1.0 AS DOUBLE) WHEN r IN ('US', 'CA') THEN 0.55 ELSE 0.4 END AS absence "
       "FROM (SELECT c_custkey, list_extract(['US', 'GB', 'JP', 'TH', 'unknown', 'CA'], CAST(c_custkey % 6 AS INTEGER) + 1) AS r FROM customer)")
def labeling_trust(spark, sf_dir):
    from dinesight.catalog.tables import pick
    region = pick(["US", "GB", "JP", "TH", "unknown", "CA"], F.col("c_custkey"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", u.labeling_trust(region).alias("trust"), u.absence_factor(region).alias("absence"))


_OFFICIAL = ("NOT (" + any_sql("h", web.NON_OFFICIAL_HOSTS) + " OR " + any_sql("regexp_replace(h, '[.-]', '', 'g')", web.DIRECTORY_HOST_HINTS)
             + ") OR " + any_sql("h", web.MENU_PLATFORM_HINTS))


@query("site_filters", "FI-3 FI-13", with_tables(
    "SELECT link_id, len(list_filter(" + sql_list(web.SOCIAL_DOMAINS) + ", lambda d: h0 = d OR ends_with(h0, '.' || d))) > 0 OR "
    + any_sql("h0 || p", web.MAPS_HINTS) + f" AS is_noise, {_OFFICIAL} AS official FROM (SELECT link_id, lower({NETLOC.format('url')}) AS h0, lower({PATH.format('url')}) AS p, "
    + HOST.format("url") + " AS h FROM links)", links=LINKS_SQL))
def site_filters(spark, sf_dir):
    url = F.col("url")
    return links(spark, sf_dir).select("link_id", u.is_noise_website(url).alias("is_noise"),
                                       u.official_host(u.host(url)).alias("official"))


@query("result_key", "PR-43", with_tables(
    "SELECT link_id, sha1('8:base:' || url || ':' || CASE WHEN len(list_filter(" + sql_list(web.SHARED_PLATFORM_HOSTS)
    + ", lambda d: h = d OR ends_with(h, '.' || d))) > 0 THEN lower(name) ELSE '' END) AS result_key FROM (SELECT *, "
    + HOST.format("url") + " AS h FROM links)", links=LINKS_SQL))
def result_key(spark, sf_dir):
    return links(spark, sf_dir).select("link_id", u.result_key(F.col("url"), F.col("name"), "base").alias("result_key"))


def _unnest_queries(queries: str, source: str) -> str:
    return (f"SELECT restaurant_id, CAST(i - 1 AS INTEGER) AS query_ord, qs[i] AS query FROM (SELECT restaurant_id, qs, "
            f"unnest(generate_series(1, len(qs))) AS i FROM (SELECT restaurant_id, {queries} AS qs FROM {source}))")


_NAMED_PLACES = ("(SELECT *, " + HOST.format("website_url") + " AS d, '\"' || name || '\"' AS q, "
                 + _PARTS.format("address") + "[2] AS city, coalesce(" + map_sql("home", pv.REGION_TOKEN)
                 + f", '') AS reg FROM (SELECT *, {HOME_SQL} AS home FROM places WHERE name IS NOT NULL))")
_ORDERED = "list_filter([{0}], lambda v: v IS NOT NULL)"


def _distinct_ordered(items: str) -> str:
    kept = _ORDERED.format(items)
    return f"list_filter({kept}, lambda v, i: list_position({kept}, v) = i)"


@query("allergen_search_queries", "PR-41", with_tables(_unnest_queries(_distinct_ordered(
    "CASE WHEN d <> '' THEN 'site:' || d || ' filetype:pdf allergen OR nutrition' END, "
    "q || CASE WHEN reg <> '' THEN ' ' || reg ELSE '' END || ' allergen filetype:pdf', "
    "CASE WHEN city IS NOT NULL THEN q || ' \"' || city || '\" allergen menu' ELSE q || CASE WHEN reg <> '' THEN ' ' || reg ELSE '' END || ' allergen menu' END"),
    _NAMED_PLACES), places=PLACES_SQL))
def allergen_search_queries(spark, sf_dir):
    from dinesight.operators.sources import search_queries
    return search_queries(places(spark, sf_dir).where("name IS NOT NULL"), "allergen")


@query("menu_pdf_search_queries", "PR-41", with_tables(_unnest_queries(_distinct_ordered(
    "CASE WHEN city IS NOT NULL THEN q || ' \"' || city || '\" menu filetype:pdf' END, "
    "CASE WHEN reg <> '' THEN q || ' ' || reg || ' menu filetype:pdf' END, q || ' menu filetype:pdf'"),
    _NAMED_PLACES), places=PLACES_SQL))
def menu_pdf_search_queries(spark, sf_dir):
    from dinesight.operators.sources import search_queries
    return search_queries(places(spark, sf_dir), "menu_pdf")


@query("website_recovery_queries", "PR-41")
def website_recovery_queries(spark, sf_dir):
    from dinesight.operators.sources import search_queries
    return search_queries(places(spark, sf_dir), "website")


_BOXES = " ".join(f"WHEN lat BETWEEN {s} AND {n} AND lon BETWEEN {w} AND {e} THEN '{c}'" for c, s, n, w, e in pv.COUNTRY_BOXES)


@query("region_from_address", "PR-21 JN-4", with_tables(
    f"SELECT restaurant_id, CASE WHEN address IS NULL THEN coalesce(CASE {_BOXES} END, 'unknown') WHEN tail = 'USA' OR tail = 'Oregon' OR regexp_matches(tail, ' [0-9]{{5}}$') THEN 'US' WHEN tail = 'United Kingdom' THEN 'GB' "
    "WHEN ends_with(tail, ' - United Arab Emirates') THEN 'AE' WHEN tail = 'Norway' THEN 'NO' WHEN tail = 'Georgia' THEN 'GE' END AS region "
    "FROM (SELECT *, latitude AS lat, longitude AS lon, trim(split_part(address, ',', -1)) AS tail FROM places)", places=PLACES_SQL))
def region_from_address(spark, sf_dir):
    return places(spark, sf_dir).select("restaurant_id", u.region_from_address(
        F.col("address"), F.col("latitude"), F.col("longitude")).alias("region"))


@query("bbox_country", "JN-4",
       f"SELECT c_custkey, CASE {_BOXES} END AS country FROM (SELECT c_custkey, CAST(-60 + (c_custkey * 17 % 1400) / 10.0 AS DOUBLE) AS lat, "
       "CAST(-170 + (c_custkey * 29 % 3500) / 10.0 AS DOUBLE) AS lon FROM customer)")
def bbox_country(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", u.country_from_point(
        F.lit(-60.0) + (k * 17 % 1400) / 10.0, F.lit(-170.0) + (k * 29 % 3500) / 10.0).alias("country"))
