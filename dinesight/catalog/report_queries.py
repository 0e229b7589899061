"""Coverage, contributions, cards and notices."""

from __future__ import annotations

from pyspark.sql import functions as F

from dinesight.catalog import query
from dinesight.catalog.evidence_queries import first
from dinesight.catalog.scoring_queries import NUT_TABLES, RISKIEST, all_class_evidence, doubles
from dinesight.catalog.source_queries import CITY_FACTS, HOST
from dinesight.catalog.tables import DISHES_SQL, LINKS_SQL, PLACES_SQL, dishes, links, pick, pick_sql, places, table, with_tables
from dinesight.functions import urls as u
from dinesight.operators import reports as r
from dinesight.operators import risk
from dinesight.operators.common import grown
from dinesight.plans import ranking as plan

_COUNTS = "count(*) AS n_items, count(*) FILTER (trim(price) <> '') AS n_priced, count(*) FILTER (len(dietary_terms) > 0) AS n_dietary, count(*) FILTER (len(allergen_terms) > 0) AS n_allergen"


def _by(kind: str, expr: str) -> str:
    return f"SELECT restaurant_id, '{kind}' AS kind, {expr} AS value, {_COUNTS} FROM dishes GROUP BY ALL"


@query("menu_summary", "AG-4", with_tables(" UNION ALL ".join([
    _by("total", "'all'"), _by("method", "extraction_method"), _by("source_type", "source_type"), _by("category", "CASE WHEN trim(category) <> '' THEN category ELSE 'Uncategorized' END")]), dishes=DISHES_SQL))
def menu_summary(spark, sf_dir):
    return r.menu_summary(dishes(spark, sf_dir))


@query("sorted_counts", "SO-4", with_tables("SELECT item_name, count(*) AS n FROM dishes GROUP BY 1 ORDER BY n DESC, item_name", dishes=DISHES_SQL))
def sorted_counts(spark, sf_dir):
    return r.sorted_counts(dishes(spark, sf_dir), "item_name")


@query("coverage_status", "AG-5", with_tables(
    "SELECT p.restaurant_id, CASE WHEN bool_or(d.source_type <> 'community') THEN 'menu_backed' WHEN count(d.arrival) > 0 OR bool_or(l.restaurant_id IS NOT NULL) THEN 'cuisine_estimate' ELSE 'no_menu_found' END AS coverage_status "
    "FROM places p LEFT JOIN dishes d ON d.restaurant_id = p.restaurant_id LEFT JOIN (SELECT DISTINCT 'c' || substr(restaurant_id, 2) AS restaurant_id FROM links UNION SELECT DISTINCT 'c' || CAST(doc_id % 997 AS VARCHAR) FROM documents) l ON l.restaurant_id = p.restaurant_id GROUP BY 1",
    places=PLACES_SQL, dishes=DISHES_SQL, links=LINKS_SQL))
def coverage_status(spark, sf_dir):
    sources = links(spark, sf_dir).select(F.concat(F.lit("c"), F.substring("restaurant_id", 2, 10)).alias("restaurant_id"))
    texts = table(spark, sf_dir, "documents").select(F.concat(F.lit("c"), (F.col("doc_id") % 997).cast("string")).alias("restaurant_id"))
    return r.coverage_status(places(spark, sf_dir), sources, texts, dishes(spark, sf_dir))


@query("item_contributions", "AG-6", with_tables(
    "SELECT CASE WHEN trim(category) <> '' THEN category ELSE 'n/a' END AS category, CAST(count(*) AS BIGINT) AS records, count(DISTINCT restaurant_id) AS restaurants, count(*) FILTER (trim(price) <> '') AS priced_items, "
    "count(*) FILTER (len(dietary_terms) > 0) AS dietary_items, count(*) FILTER (len(allergen_terms) > 0) AS allergen_items FROM dishes GROUP BY 1", dishes=DISHES_SQL))
def item_contributions(spark, sf_dir):
    return r.item_contributions(dishes(spark, sf_dir), "category")


@query("text_contributions", "AG-6",
       "SELECT source, count(*) AS records, count(DISTINCT doc_id % 30) AS restaurants, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(sum(doc_id % 7) AS BIGINT) AS prices FROM documents GROUP BY 1")
def text_contributions(spark, sf_dir):
    from dinesight.catalog.tables import table
    rows = table(spark, sf_dir, "documents").select("source", (F.col("doc_id") % 30).alias("restaurant_id"), F.col("n_chars").alias("char_count"), (F.col("doc_id") % 7).alias("price_count"))
    return r.text_contributions(rows, "source")


@query("restaurant_coverage", "AG-7", with_tables(
    "SELECT (SELECT count(DISTINCT restaurant_id) FROM places) AS inspected, count(DISTINCT restaurant_id) AS with_candidates, count(DISTINCT restaurant_id) FILTER (validation_status = 'validated') AS with_validated FROM links",
    places=PLACES_SQL, links=LINKS_SQL))
def restaurant_coverage(spark, sf_dir):
    return r.restaurant_coverage(links(spark, sf_dir), places(spark, sf_dir))


def _texts(spark, sf_dir):
    return dishes(spark, sf_dir).where("source_type = 'pdf'").select("restaurant_id", F.length("description").alias("char_count"))


@query("dashboard_cards", "AG-8 JN-28 SO-5", with_tables(
    "SELECT c.*, coalesce(t.n, 0) AS text_records, coalesce(t.ch, 0) AS text_chars, p.name FROM (SELECT restaurant_id, CAST(count(*) AS BIGINT) AS item_count, count(*) FILTER (trim(price) <> '') AS price_count, count(*) FILTER (len(allergen_terms) > 0) AS allergen_count, "
    "array_to_string(list_sort(list(DISTINCT extraction_method)), ',') AS methods FROM dishes GROUP BY 1) c LEFT JOIN (SELECT restaurant_id, count(*) AS n, CAST(sum(length(description)) AS BIGINT) AS ch FROM dishes WHERE source_type = 'pdf' GROUP BY 1) t USING (restaurant_id) "
    "LEFT JOIN places p USING (restaurant_id)", dishes=DISHES_SQL, places=PLACES_SQL))
def dashboard_cards(spark, sf_dir):
    cards = r.dashboard_cards(dishes(spark, sf_dir), _texts(spark, sf_dir), places(spark, sf_dir).select("restaurant_id", "name"))
    return r.cards_order(cards).select("restaurant_id", "item_count", "price_count", "allergen_count", F.array_join(F.map_keys("method_counts"), ",").alias("methods"), "text_records", "text_chars", "name")


@query("attach_metadata", "JN-28", with_tables("SELECT d.arrival, p.name, p.address FROM dishes d LEFT JOIN places p ON p.restaurant_id = d.restaurant_id", dishes=DISHES_SQL, places=PLACES_SQL))
def attach_metadata(spark, sf_dir):
    return r.attach_metadata(dishes(spark, sf_dir), places(spark, sf_dir).select("restaurant_id", "name", "address")).select("arrival", "name", "address")


_TIERS = ["avoid", "caution", "likely_ok"]


def _cards(spark, sf_dir, shift: int):
    k = F.col("k")
    return places(spark, sf_dir).select("restaurant_id", "k", ((k + shift) % 10 / 10.0).alias("risk"), pick(_TIERS, k + shift * (k % 2)).alias("tier"), F.lit("cuisine_prior").alias("basis"))


@query("compare_surfaces", "JN-30", with_tables(
    f"SELECT restaurant_id, {pick_sql(_TIERS, 'k')} = {pick_sql(_TIERS, 'k + k % 2')} AS tier_match, k % 10 = (k + 1) % 10 AS risk_match FROM places", places=PLACES_SQL))
def compare_surfaces(spark, sf_dir):
    return r.compare_surfaces(_cards(spark, sf_dir, 0), _cards(spark, sf_dir, 1), ["restaurant_id"], ["tier", "risk"])


@query("prior_then_upgrade", "RS-12", with_tables(
    f"SELECT restaurant_id, CASE WHEN k % 4 = 0 THEN {pick_sql(_TIERS, 'k + 2 * (k % 2)')} ELSE {pick_sql(_TIERS, 'k')} END AS tier, k % 4 = 0 AS is_menu_backed FROM places", places=PLACES_SQL))
def prior_then_upgrade(spark, sf_dir):
    backed = _cards(spark, sf_dir, 2).where("k % 4 = 0")
    return r.prior_then_upgrade(_cards(spark, sf_dir, 0), backed).select("restaurant_id", "tier", "is_menu_backed")


@query("region_notice", "RS-11", with_tables(
    "SELECT restaurant_id, home, source_region, coalesce(source_region = home, false) AS verified FROM (SELECT restaurant_id, home, arg_min(region, (CASE WHEN home IS NULL OR region <> home THEN 0 ELSE 1 END, fst)) AS source_region FROM ("
    "SELECT u.restaurant_id, u.fst, u.al, bool_or(u.al) OVER (PARTITION BY u.restaurant_id) AS has_al, CASE WHEN u.k % 3 = 0 THEN 'GB' WHEN u.k % 3 = 1 THEN 'US' END AS home, CASE WHEN menu_source_url LIKE '%.uk/%' THEN 'GB' WHEN menu_source_url LIKE '%.de/%' THEN 'DE' WHEN menu_source_url LIKE '%.nz/%' THEN 'NZ' END AS region "
    "FROM (SELECT restaurant_id, k, menu_source_url, bool_or(len(allergen_terms) > 0) AS al, min(arrival) AS fst FROM dishes GROUP BY ALL) u) WHERE (al OR NOT has_al) AND region IS NOT NULL GROUP BY ALL)", dishes=DISHES_SQL))
def region_notice(spark, sf_dir):
    items = dishes(spark, sf_dir)
    k = F.col("k")
    rest = items.select("restaurant_id", "k").distinct().select("restaurant_id", F.when(k % 3 == 0, "GB").when(k % 3 == 1, "US").alias("home"))
    coverage = items.select(F.col("menu_source_url").alias("source_url")).distinct().withColumn("region", u.host_country(u.netloc(F.col("source_url"))))
    return r.region_notice(rest, items, coverage).select("restaurant_id", "home", "source_region", "verified")


@query("location_notice", "RS-11", with_tables(
    "SELECT restaurant_id, city AS home_city, coalesce(min(CASE WHEN mm THEN shown END), '') AS shown_city, CASE WHEN bool_or(mm) THEN 'labeled' WHEN bool_or(url_has) AND NOT bool_or(url_has AND validation_status = 'validated') THEN 'inferred' END AS confidence "
    f"FROM (SELECT *, validation_status = 'validated' AND coalesce(city <> '' AND NOT url_has AND shown IS NOT NULL AND shown <> city, false) AS mm FROM {CITY_FACTS}) WHERE city <> '' GROUP BY ALL HAVING bool_or(validation_status = 'validated') AND confidence IS NOT NULL", links=LINKS_SQL))
def location_notice(spark, sf_dir):
    rows = links(spark, sf_dir)
    rest = rows.select("restaurant_id", "name", "address").distinct()
    # Menus are shown from validated links; the others were found, too.
    items = rows.where("validation_status = 'validated'").select("restaurant_id", F.col("url").alias("menu_source_url"))
    return r.location_notice(rest, items, rows.select("restaurant_id", "url"))


@query("used_hosts", "AG-32", with_tables(
    "SELECT restaurant_id, host, n, CAST(rn AS INTEGER) AS position FROM " + first(
        "(SELECT restaurant_id, " + HOST.format("menu_source_url") + " AS host, count(*) AS n FROM dishes GROUP BY ALL)", "restaurant_id", "n DESC, host", 6), dishes=DISHES_SQL))
def used_hosts(spark, sf_dir):
    return r.used_hosts(dishes(spark, sf_dir))


@query("sample_items", "AG-32", with_tables("SELECT restaurant_id, item_name, CAST(rn AS INTEGER) AS position FROM " + first("dishes", "restaurant_id", "arrival", 6), dishes=DISHES_SQL))
def sample_items(spark, sf_dir):
    return r.sample_items(dishes(spark, sf_dir)).select("restaurant_id", "item_name", "position")


_QUOTES = (f"(SELECT restaurant_id, position, text AS quote FROM (SELECT 's' || CAST(conv_id % 100 AS VARCHAR) AS restaurant_id, n * 50 % 1000 AS position, text, {pick_sql(plan.REVIEW_KINDS, 'n')} AS type "
           "FROM (SELECT *, conv_id * 3 + turn AS n FROM conversations)) WHERE type IN ('adverse_event', 'allergen_presence', 'good_handling'))")
_DOSSIER = (
    "SELECT s.user_id, p.restaurant_id, p.name, coalesce(s.tier, 'unknown') AS tier, s.tier IS NOT NULL AS verified, s.risk, coalesce(s.basis, '') AS basis, coalesce(w.watch, '') AS watch, coalesce(w.n_watch, 0) AS n_watch, "
    "coalesce(f.parsed, 0) AS parsed_count, greatest(0, coalesce(f.parsed, 0) - coalesce(w.shown, 0)) AS other_count, coalesce(q.quotes, '') AS quotes, coalesce(q.n_quotes, 0) AS n_quotes, "
    "coalesce(u.sources, '') AS sources, coalesce(u.n_sources, 0) AS n_sources, r.ask_staff, r.nut_free_claim FROM places p LEFT JOIN scored s ON s.restaurant_id = p.restaurant_id "
    "LEFT JOIN flags f ON f.restaurant_id = p.restaurant_id LEFT JOIN rest r ON r.restaurant_id = p.restaurant_id "
    f"LEFT JOIN (SELECT restaurant_id, string_agg(name, '|' ORDER BY position) AS watch, count(*) AS n_watch, count(*) AS shown FROM ({RISKIEST}) GROUP BY 1) w ON w.restaurant_id = p.restaurant_id "
    "LEFT JOIN (SELECT restaurant_id, md5(string_agg(quote, '|' ORDER BY position, quote) FILTER (rn <= 12)) AS quotes, count(*) AS n_quotes FROM (SELECT *, row_number() OVER (PARTITION BY restaurant_id ORDER BY position, quote) AS rn "
    f"FROM {_QUOTES}) GROUP BY 1) q ON q.restaurant_id = p.restaurant_id "
    "LEFT JOIN (SELECT restaurant_id, string_agg(menu_source_url, '|' ORDER BY menu_source_url) AS sources, count(*) AS n_sources FROM (SELECT DISTINCT restaurant_id, menu_source_url FROM dishes) GROUP BY 1) u ON u.restaurant_id = p.restaurant_id")


def _quotes(spark, sf_dir):
    shown = plan.reviews(spark, sf_dir).where(F.col("type").isin("adverse_event", "allergen_presence", "good_handling"))
    return shown.select("restaurant_id", F.col("age_days").alias("position"), "quote", "type")


@query("dossier", "RS-13", doubles(with_tables(_DOSSIER, **NUT_TABLES)))
def dossier(spark, sf_dir):
    verdicts = risk.profile_rollup(plan.assessed(spark, sf_dir, "nuts"))
    evidence = all_class_evidence(spark, sf_dir)
    signals = plan.restaurants(spark, sf_dir).select("restaurant_id", *risk.SIGNALS)
    sources = dishes(spark, sf_dir).select("restaurant_id", F.col("menu_source_url").alias("source_url"))
    out = r.dossier(places(spark, sf_dir), verdicts, risk.riskiest_items(evidence), signals, items=evidence.select("restaurant_id", "parsed"),
                    quotes=_quotes(spark, sf_dir).drop("type"), sources=sources)

    def joined(c):
        return F.coalesce(F.array_join(c, "|"), F.lit(""))

    return out.select("user_id", "restaurant_id", "header.name", "verdict.tier", "verdict.verified", F.col("verdict.overall_risk").alias("risk"), "verdict.basis",
                      joined(F.col("dishes.watch.name")).alias("watch"), "dishes.n_watch", "dishes.parsed_count", "dishes.other_count",
                      F.when(F.col("community.quotes").isNotNull(), F.md5(joined(F.col("community.quotes")))).otherwise("").alias("quotes"), "community.n_quotes",
                      joined(F.col("provenance.sources")).alias("sources"), "provenance.n_sources", "restaurant_signals.ask_staff", "restaurant_signals.nut_free_claim")


@query("score_bundles", "RS-10")
def score_bundles(spark, sf_dir):
    evidence = all_class_evidence(spark, sf_dir)
    charts = evidence.groupBy("restaurant_id").agg(F.bool_or("chart").alias("chart"))
    named = places(spark, sf_dir).select("restaurant_id", "name")
    rests = plan.restaurants(spark, sf_dir).join(grown(charts), "restaurant_id", "left").join(grown(named), "restaurant_id", "left").withColumn("chart", F.coalesce("chart", F.lit(False)))
    flagged = risk.riskiest_items(evidence).where("NOT is_suspected").select("restaurant_id", "position", "name")
    menus, quotes = risk.compact_menu(dishes(spark, sf_dir)), _quotes(spark, sf_dir)
    # A bundle says nothing of its user: it is written once per restaurant and different pref.
    bundles = plan.assessed(spark, sf_dir, "nuts", told=lambda verdicts: r.score_bundles(verdicts, rests, menus, quotes, flagged, keys=["restaurant_id", "pref_key"]), in_order=True)
    return bundles.select("user_id", "restaurant_id", "allergen", "scenario", "bundle")
