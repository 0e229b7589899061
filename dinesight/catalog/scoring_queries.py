"""Prefs, scoring ladder, roll-up and ranking."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from dinesight.catalog import query
from dinesight.catalog.place_queries import CUISINES
from dinesight.catalog.source_queries import HOST
from dinesight.catalog.tables import DISHES_SQL, PLACES_SQL, dishes, pick, pick_sql, places, sql_list, table, with_tables
from dinesight.catalog.tagging_queries import (
    FACTS_SQL, GENERIC_KB_SQL, ITEM_PRIOR_SQL, KB_ROWS, KB_SQL, PRIOR_PLACES, SUSPECT_SQL, TEXTS_SQL, facts_sql)
from dinesight.functions.literals import text_array
from dinesight.operators import diet as dt
from dinesight.operators import risk
from dinesight.operators.common import spread
from dinesight.plans import ranking as plan
from dinesight.vocab import places as pv
from dinesight.vocab import scoring as sv



def doubles(sql: str) -> str:
    """Decimal literals as doubles, so both sides add the same numbers."""
    return re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])", r"\1e0", sql)


KB = [dict(zip(("allergen", "pattern", "risk", "note", "ord"), row)) for row in KB_ROWS]


# --- SQL of the derived tables ------------------------------------------------------
REST_SQL = (
    f"SELECT 's' || CAST(k AS VARCHAR) AS restaurant_id, k, cuisines, {pick_sql(plan.REGIONS, 'k')} AS region, coalesce({HOST.format('website_url')}, '') AS official_domain, "
    "round((CAST(name IS NOT NULL AS INT) + CAST(address IS NOT NULL AS INT) + CAST(website_url IS NOT NULL AS INT) + CAST(phone_number IS NOT NULL AS INT) + CAST(opening_hours IS NOT NULL AS INT) + 1 "
    "+ CAST(coalesce(trim(source_last_updated) <> '', false) AS INT)) / CAST(7 AS DOUBLE), 3) AS quality, k % 9 = 0 AS nut_free_claim, k % 7 = 0 AS cross_contact_warning, k % 5 = 0 AS ask_staff, "
    f"k % 11 = 0 AS allergen_menu_available, k % 6 = 0 AS allergy_disclaimer FROM {CUISINES} WHERE source_name = 'openstreetmap'")
PAIRS_SQL = "SELECT DISTINCT o_custkey AS user_id, 's' || CAST(l_suppkey AS VARCHAR) AS restaurant_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
_CROSS = "CASE WHEN c_custkey % 4 = 2 THEN 'not_concerned' WHEN c_custkey % 4 = 3 THEN 'strict' END"


def prefs_sql(order: int, allergen: str, where: str = "true") -> str:
    return f"SELECT c_custkey AS user_id, {order} AS pref_ord, '{allergen}' AS allergen, {pick_sql(plan.SEVERITIES, f'c_custkey + {order}')} AS severity, {_CROSS} AS cross_contact FROM customer WHERE {where}"


REVIEWS_SQL = (f"SELECT 's' || CAST(conv_id % 100 AS VARCHAR) AS restaurant_id, {pick_sql(plan.REVIEW_KINDS, 'n')} AS type, {pick_sql(plan.REVIEW_ALLERGENS, 'n * 2')} AS allergen, n * 50 % 1000 AS age_days "
               "FROM (SELECT conv_id, conv_id * 3 + turn AS n FROM conversations)")
_W = "(CASE WHEN allergen <> '' THEN 0.7 ELSE 0.5 END * CASE WHEN age_days <= 365 THEN 1.0 WHEN age_days <= 730 THEN 0.6 ELSE 0.3 END)"


def community_sql(match: str) -> str:
    """Adverse and poor reports of each restaurant for one allergen class."""
    adverse = f"type IN ('adverse_event', 'allergen_presence') AND ({match})"
    return (f"SELECT restaurant_id, count(*) FILTER ({adverse}) AS n_adv, max({_W}) FILTER ({adverse}) AS b_adv, count(*) FILTER (type = 'poor_handling') AS n_poor, "
            f"max({_W}) FILTER (type = 'poor_handling') AS b_poor FROM reviews GROUP BY 1")


_TRUST = ("CASE WHEN regexp_replace(regexp_extract(d.menu_source_url, '//([^/]*)', 1), '^www[.]', '') = r.official_domain THEN 1.0 ELSE 0.7 END * CASE WHEN d.menu_source_url LIKE '%/2024' THEN 1.0 "
          "WHEN d.menu_source_url LIKE '%/2019' THEN 0.52 ELSE 0.9 END")


def flags_sql(prior: str, base: str, hit: str, cross: str, covers: str, suspected: str, source: str, other: str = "") -> str:
    """Dish evidence of one class, per restaurant; ``other`` tells the nuts that a selection leaves out."""
    each, any_other = (f", bool_or({other}) AS other_nuts", ", bool_or(other_nuts) AS other_nuts") if other else ("", "")
    per_dish = (f"SELECT d.restaurant_id, trim(d.item_name) AS name, count(*) FILTER (extraction_method <> 'community_mention') AS parsed, max({prior}) AS prior, max({base}) AS base, "
                f"bool_or(chart AND {hit}) AS chart_hit, bool_or(NOT chart AND {hit}) AS text_hit, bool_or({cross}) AS cross_hit, bool_or({suspected}) AS suspected, bool_or(chart) AS chart, "
                f"bool_or(chart AND {covers}) AS covers, min(CASE WHEN chart THEN {_TRUST} END) AS trust{each} FROM {source} d JOIN rest r ON r.restaurant_id = d.restaurant_id GROUP BY ALL")
    risky = "(chart_hit OR text_hit OR coalesce(prior >= greatest(0.5, base + 0.1), false))"
    return (f"SELECT restaurant_id, CAST(sum(parsed) AS BIGINT) AS parsed, count(prior) AS n_details, max(prior) AS top, count(*) FILTER ({risky}) AS risky, count(*) FILTER (suspected AND NOT {risky}) AS suspected, "
            f"bool_or(chart_hit) AS chart_hit, bool_or(text_hit) AS text_hit, bool_or(cross_hit) AS cross_hit, bool_or(chart) AS chart, bool_or(covers) AS covers, min(trust) AS trust{any_other} FROM ({per_dish}) GROUP BY 1")


_SEV = {i: "CASE severity " + " ".join(f"WHEN '{k}' THEN {v[i]!r}" for k, v in sv.SEVERITY.items()) + " END" for i in range(4)}


_AWARE, _SPARED = "(allergy_disclaimer OR ask_staff OR allergen_menu_available)", "(lvl = 'strict' AND safe >= 3 AND NOT (parsed > 0 AND share >= 0.6))"
_REASONS = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {holds} THEN {text} END" for holds, text in (
    ("nav_ok", "'avoid_flagged_dishes:' || risky || '/' || parsed"), ("nav_ok AND susp > 0", "'some_types_may_hide_it:' || susp || '/' || parsed"), (f"nav_ok AND {_AWARE}", "'handles_allergies'"),
    ("NOT nav_ok AND risky = 0 AND susp > 0", "'only_types_that_may_hide_it:' || susp || '/' || parsed"),
    (f"NOT nav_ok AND risky > 0 AND {_SPARED}", "'traces_matter_to_this_diner:' || safe || '/' || parsed"), (f"NOT nav_ok AND risky > 0 AND NOT {_SPARED}", "'across_the_menu:' || risky || '/' || parsed"),
    ("clean", "'chart_does_not_list_it'"), ("claim", "'nut_free_claim'"), ("seen", "'menu_does_not_name_it:' || parsed || '/' || parsed"), ("chart AND covers AND trust < 0.85", "'chart_from_elsewhere'"),
    ("ccf > r2", "'cross_contact_warning'"), ("reported", "'diners_reported_it'"))) + "], lambda x: x IS NOT NULL), ',')"


def ladder_sql(base: str, base_conf: str, is_nut: bool, selects: bool = False) -> str:
    """The fusion ladder for one class; reads flags, rest, comm, prefs, pairs. ``selects``: a class of some nuts, which others raise."""
    other_nuts = "coalesce(f.other_nuts, false) AS other_nuts, " if selects else ""
    labels, mandates = ", ".join(repr(c) for c in pv.HIGH_LABELING_REGIONS), ", ".join(repr(c) for c in pv.MANDATE_REGIONS)
    s0 = (f"SELECT q.user_id, q.restaurant_id, p.pref_ord, p.allergen, p.severity, {_SEV[0]} AS sev, {_SEV[1]} AS caution, {_SEV[2]} AS floor, coalesce(p.cross_contact, {_SEV[3]}) AS lvl, r.*, "
          "coalesce(f.parsed, 0) AS parsed, coalesce(f.n_details, 0) AS n_details, coalesce(f.top, 0) AS top, coalesce(f.risky, 0) AS risky, coalesce(f.suspected, 0) AS susp, coalesce(f.chart_hit, false) AS chart_hit, "
          "coalesce(f.text_hit, false) AS text_hit, coalesce(f.cross_hit, false) AS cross_hit, coalesce(f.chart, false) AS chart, coalesce(f.covers, false) AS covers, coalesce(f.trust, 1.0) AS trust, " + other_nuts +
          f"coalesce(m.n_adv, 0) AS n_adv, m.b_adv, coalesce(m.n_poor, 0) AS n_poor, m.b_poor, {base} AS base, {base_conf} AS base_conf, CASE WHEN r.region IN ({labels}) THEN 0.7 ELSE 0.35 END AS lab, "
          f"CASE WHEN r.region IN ({mandates}) THEN 1.0 WHEN r.region IN ('US', 'CA') THEN 0.55 ELSE 0.4 END AS absence FROM pairs q JOIN prefs p ON p.user_id = q.user_id JOIN rest r ON r.restaurant_id = q.restaurant_id "
          "LEFT JOIN flags f ON f.restaurant_id = q.restaurant_id LEFT JOIN comm m ON m.restaurant_id = q.restaurant_id")
    has_claim = "nut_free_claim" if is_nut else "false"
    s1 = (f"SELECT *, chart_hit OR text_hit AS presence, text_hit AND NOT chart_hit AS text_only, greatest(0, parsed - risky) AS safe, CASE WHEN parsed > 0 THEN risky / CAST(parsed AS DOUBLE) ELSE 0 END AS share, "
          "CASE WHEN parsed > 0 THEN susp / CAST(parsed AS DOUBLE) ELSE 0 END AS sshare, least(0.97, CASE WHEN n_details > 0 THEN greatest(base, top) ELSE base END) AS r0, "
          f"CASE WHEN n_details = 0 THEN base_conf ELSE {'CASE WHEN top >= 0.5 THEN 0.8 ELSE 0.55 END' if is_nut else '0.6'} END AS c0, CASE WHEN n_details > 0 AND top >= 0.5 THEN 'dish_prior' ELSE 'cuisine_prior' END AS b0 FROM ({s0})")
    s2 = (f"SELECT *, risky > 0 AND safe >= 3 AND NOT (parsed > 0 AND share >= 0.6) AND lvl <> 'strict' AS nav_ok, (CASE WHEN chart_hit THEN 0.7 * (0.22 + 0.55 * share + 0.25 * sshare) WHEN text_only THEN 0.22 + 0.55 * share + 0.25 * sshare "
          f"ELSE greatest(0.22 + 0.55 * share + 0.25 * sshare, 0.7 * base) END) * CASE WHEN allergy_disclaimer OR ask_staff OR allergen_menu_available THEN 0.85 ELSE 1 END AS nav FROM ({s1})")
    s3 = ("SELECT *, CASE WHEN nav_ok THEN greatest(caution, least(r0, nav)) WHEN risky = 0 AND susp > 0 THEN CASE WHEN lvl = 'strict' THEN greatest(r0, 0.5) ELSE greatest(caution, least(r0, 0.18 + 0.25 * sshare)) END "
          "WHEN risky > 0 AND chart_hit THEN greatest(r0, 0.9) WHEN risky > 0 AND text_only THEN greatest(r0, 0.8) ELSE r0 END AS r1, "
          "CASE WHEN nav_ok THEN greatest(c0, CASE WHEN chart_hit THEN 0.8 ELSE 0.6 END) WHEN risky = 0 AND susp > 0 THEN least(c0, 0.4) WHEN risky > 0 AND chart_hit THEN greatest(c0, 0.9) WHEN risky > 0 AND text_only THEN greatest(c0, 0.7) ELSE c0 END AS c1, "
          f"CASE WHEN risky = 0 AND susp > 0 THEN 'suspected_nuts' WHEN risky = 0 THEN b0 WHEN chart_hit THEN 'allergen_matrix' WHEN text_only THEN 'menu_evidence' ELSE 'dish_prior' END AS b1 FROM ({s2})")
    s4 = (f"SELECT *, NOT presence AND chart AND covers AS clean, NOT presence AND NOT (chart AND covers) AND {has_claim} AS claim, least(1.0, parsed / 20.0) AS cov FROM ({s3})")
    s5 = (f"SELECT *, greatest(floor, r1 * (1 - cov * absence * 0.22)) AS low, NOT presence AND NOT clean AND NOT claim AND b1 = 'cuisine_prior' AND parsed > 0 AND greatest(floor, r1 * (1 - cov * absence * 0.22)) < r1 AS seen FROM ({s4})")
    s6 = ("SELECT *, CASE WHEN clean THEN greatest(floor, r1 * (1 - lab * trust * 0.75)) WHEN claim THEN greatest(floor, r1 * (1 - lab * 0.5)) WHEN seen THEN low ELSE r1 END AS r2, "
          "CASE WHEN clean THEN greatest(c1, 0.8 * trust) WHEN claim THEN greatest(c1, 0.6) WHEN seen THEN greatest(c1, 0.5 + 0.2 * cov) ELSE c1 END AS c2, "
          "CASE WHEN clean THEN 'allergen_matrix' WHEN claim AND b1 = 'cuisine_prior' THEN 'restaurant_signal' WHEN seen THEN 'menu_coverage' ELSE b1 END AS b2, "
          f"CASE WHEN cross_contact_warning OR cross_hit THEN CASE lvl WHEN 'strict' THEN 0.45 WHEN 'moderate' THEN 0.35 ELSE 0 END ELSE 0 END AS ccf FROM ({s5})")
    s7 = ("SELECT *, greatest(r2, ccf) AS r3, CASE WHEN ccf > 0 AND b2 = 'cuisine_prior' THEN 'restaurant_signal' ELSE b2 END AS b3, CASE WHEN n_adv > 0 THEN least(0.25, 0.25 * least(1.0, b_adv + 0.15 * (n_adv - 1))) ELSE 0 END "
          f"+ CASE WHEN n_poor > 0 THEN least(0.05, 0.05 * least(1.0, b_poor + 0.15 * (n_poor - 1))) ELSE 0 END AS delta FROM ({s6})")
    if selects:
        bump = "CASE lvl " + " ".join(f"WHEN '{k}' THEN {v[1]!r}" for k, v in sv.CROSS_CONTACT.items()) + " END"
        bumped = f"SELECT *, least(least(0.97, r3 + {bump}), {sv.OTHER_NUT_CEILING!r}) AS bumped FROM ({s7})"
        raised = f"SELECT *, other_nuts AND NOT presence AND bumped > r3 AS is_raised FROM ({bumped})"
        s7 = f"SELECT * REPLACE (CASE WHEN is_raised THEN bumped ELSE r3 END AS r3, CASE WHEN is_raised THEN greatest(c2, 0.4) ELSE c2 END AS c2) FROM ({raised})"
    s8 = ("SELECT *, least(0.97, r3 + delta) AS r5, CASE WHEN n_adv > 0 THEN greatest(c2, least(0.6, 0.3 + 0.1 * n_adv)) ELSE c2 END AS c5, n_adv > 0 AND least(0.97, r3 + delta) > r3 + 1e-9 AS reported FROM (" + s7 + ")")
    return ("SELECT user_id, restaurant_id, pref_ord, allergen, severity, round(CAST(r5 AS DOUBLE), 3) AS risk, round(CAST(c5 AS DOUBLE), 2) AS confidence, CASE WHEN chart_hit AND NOT nav_ok THEN 'avoid' "
            "WHEN presence AND NOT chart_hit AND sev >= 1 THEN 'avoid' WHEN reported AND r5 >= 0.5 AND sev >= 2 THEN 'avoid' WHEN r5 >= caution THEN 'caution' ELSE 'likely_ok' END AS tier, b3 AS basis, reported AS community_reported, "
            f"parsed AS menu_total, risky AS menu_flagged, susp AS menu_suspected, nav_ok AS navigable, quality, {_REASONS} AS reasons FROM ({s8})")


_NUTS_HIT = "list_has_any(allergen_terms, ['peanut', 'tree nut', 'almond'])"
_NUT_ITEMS = f"(SELECT *, extraction_method = 'allergen_matrix' AS chart FROM ({ITEM_PRIOR_SQL}))"
NUT_FLAGS = flags_sql("prior_risk", "base_risk", _NUTS_HIT, "list_has_any(cross_contact_terms, ['peanut', 'tree nut'])",
                      "list_has_any(matrix_allergen_columns, ['peanut', 'tree nut'])", "prior_basis = 'suspected_nuts'", _NUT_ITEMS)
COMMON = dict(dishes=DISHES_SQL, places=PLACES_SQL, kb=KB_SQL, suspects=SUSPECT_SQL, texts=TEXTS_SQL, pplaces=PRIOR_PLACES, facts=FACTS_SQL, rest=REST_SQL,
              pairs=PAIRS_SQL, reviews=REVIEWS_SQL)
_NUT_BASE = "(SELECT least(0.97, pp.base0 * CASE WHEN pp.home THEN 1.25 ELSE 1 END) FROM pplaces pp WHERE pp.restaurant_id = q.restaurant_id)"
_NUT_CONF = "(SELECT pp.conf0 FROM pplaces pp WHERE pp.restaurant_id = q.restaurant_id)"
NUT_TABLES = COMMON | dict(prefs=prefs_sql(0, "nuts"), flags=NUT_FLAGS, comm=community_sql("allergen IN ('', 'peanuts', 'nuts')"), scored=ladder_sql(_NUT_BASE, _NUT_CONF, True))
_OUT = "user_id, restaurant_id, allergen, severity, risk, confidence, tier, basis, community_reported, menu_total, menu_flagged, menu_suspected, navigable"
_COLUMNS = _OUT.replace(" ", "").split(",")


@query("score_nuts", "RS-2 AG-10 RS-4 RS-5 RS-6 RS-7", doubles(with_tables(f"SELECT {_OUT} FROM scored", **NUT_TABLES)))
def score_nuts(spark, sf_dir):
    return plan.assessed(spark, sf_dir, "nuts").select(*_COLUMNS)


_MILK_BASE = "list_max(list_transform(list_concat(r.cuisines, ['_']), lambda c: CASE c WHEN 'italian' THEN 0.55 WHEN 'french' THEN 0.55 WHEN 'indian' THEN 0.5 WHEN 'american' THEN 0.45 ELSE 0.3 END))"
_HOME = "(SELECT pp.home FROM pplaces pp WHERE pp.restaurant_id = {0}.restaurant_id)"
_MILK_ITEMS = ("(SELECT d.*, d.extraction_method = 'allergen_matrix' AS chart, (SELECT max(g.risk) FROM gkb g WHERE g.allergen = 'milk' AND contains(trim(lower(d.item_name || ' ' || d.description)), g.pattern)) AS kbr, "
               + _HOME.format("d") + " AS home FROM dishes d)")
_MILK_BASED = f"least(0.97, {_MILK_BASE} * CASE WHEN {{h}} THEN 1.25 ELSE 1 END)"
MILK_FLAGS = flags_sql("least(0.97, kbr * CASE WHEN home THEN 1.1 ELSE 1 END)", _MILK_BASED.format(h="home"), "list_contains(allergen_terms, 'milk')",
                       "(list_contains(allergen_terms, 'may contain milk') OR list_contains(cross_contact_terms, 'milk'))", "list_contains(matrix_allergen_columns, 'milk')", "false", _MILK_ITEMS)
MILK_TABLES = COMMON | dict(gkb=GENERIC_KB_SQL, prefs=prefs_sql(1, "milk", "c_custkey % 3 = 0"), flags=MILK_FLAGS, comm=community_sql("allergen IN ('', 'milk')"),
                            scored=ladder_sql(_MILK_BASED.format(h=_HOME.format("r")), "0.5", False))


@query("score_generic", "RS-3", doubles(with_tables(f"SELECT {_OUT} FROM scored", **MILK_TABLES)))
def score_generic(spark, sf_dir):
    return plan.assessed(spark, sf_dir, "milk", kb=KB).select(*_COLUMNS)


@query("score_reasons", "RS-15", doubles(with_tables("SELECT user_id, restaurant_id, tier, reasons FROM scored", **NUT_TABLES)))
def score_reasons(spark, sf_dir):
    scored = plan.assessed(spark, sf_dir, "nuts", with_reasons=True)
    texts = F.transform("reasons", lambda x: F.concat(x["code"], F.when(x["n"].isNotNull(), F.concat(F.lit(":"), x["n"].cast("string"), F.lit("/"), x["total"].cast("string"))).otherwise("")))
    return scored.select("user_id", "restaurant_id", "tier", F.array_join(texts, ",").alias("reasons"))


@query("score_prefs", "RS-8")
def score_prefs(spark, sf_dir):
    return plan.assessed(spark, sf_dir, kb=KB, with_rationale=True).select("user_id", "restaurant_id", "class_key", "risk", "tier", "basis", "rationale")


_ROLLED = ("SELECT user_id, restaurant_id, max(risk) AS overall_risk, arg_max(confidence, ord) AS overall_confidence, arg_max(tier, ord) AS tier, arg_max(basis, ord) AS evidence_basis, "
           "arg_max(allergen, ord) AS worst_allergen, bool_or(community_reported) AS community_reported, max(quality) AS quality FROM (SELECT *, [CASE tier WHEN 'avoid' THEN 2 WHEN 'caution' THEN 1 ELSE 0 END, risk, -pref_ord]::DOUBLE[] AS ord "
           "FROM both_scored) GROUP BY ALL")
BOTH = {k: v for k, v in NUT_TABLES.items() if k not in ("scored", "prefs", "flags", "comm")} | dict(
    gkb=GENERIC_KB_SQL, both_scored="SELECT * FROM (WITH prefs AS (" + NUT_TABLES["prefs"] + "), flags AS (" + NUT_FLAGS + "), comm AS (" + NUT_TABLES["comm"] + ") " + NUT_TABLES["scored"]
    + ") UNION ALL SELECT * FROM (WITH prefs AS (" + MILK_TABLES["prefs"] + "), flags AS (" + MILK_FLAGS + "), comm AS (" + MILK_TABLES["comm"] + ") " + MILK_TABLES["scored"] + ")", rolled=_ROLLED)


def _both(spark, sf_dir, told=None):
    """Family-level nut prefs and milk prefs together."""
    prefs = plan.user_prefs(spark, sf_dir).withColumn("nut_types", F.lit(None).cast("array<string>"))
    return risk.score(plan.requested_pairs(spark, sf_dir), prefs, plan.restaurants(spark, sf_dir), dishes(spark, sf_dir), plan.reviews(spark, sf_dir), plan.AS_OF_YEAR, kb=KB, told=told)


def _scored_part(tables: dict[str, str]) -> str:
    return "SELECT * FROM (WITH " + ", ".join(f"{name} AS ({tables[name]})" for name in ("facts", "prefs", "flags", "comm")) + " " + tables["scored"] + ")"


# Users of ``plan.user_prefs`` as they are: nuts, some of them narrowed to two, and milk.
_PICKED = NUT_TABLES | dict(
    facts=facts_sql("['tree_nuts']", "['almond', 'pine_nut']", " AND list_contains(k.families, 'tree_nuts')"), prefs=prefs_sql(0, "nuts", "c_custkey % 5 = 1"), comm=community_sql("allergen IN ('', 'nuts')"), scored=ladder_sql(_NUT_BASE, _NUT_CONF, True, True),
    flags=flags_sql("prior_risk", "base_risk", "list_has_any(allergen_terms, ['tree nut', 'almond'])", "list_contains(cross_contact_terms, 'tree nut')", "list_contains(matrix_allergen_columns, 'tree nut')",
                    "prior_basis = 'suspected_nuts'", _NUT_ITEMS, "list_contains(allergen_terms, 'peanut')"))
ALL_PREFS = {k: v for k, v in COMMON.items() if k != "facts"} | dict(gkb=GENERIC_KB_SQL, all_scored=" UNION ALL ".join(
    _scored_part(t) for t in (NUT_TABLES | dict(prefs=prefs_sql(0, "nuts", "c_custkey % 5 <> 1")), _PICKED, MILK_TABLES)))


@query("profile_rollup", "AG-13", doubles(with_tables(
    "SELECT user_id, restaurant_id, overall_risk, overall_confidence, tier, evidence_basis, worst_allergen, community_reported FROM rolled", **BOTH)))
def profile_rollup(spark, sf_dir):
    return risk.profile_rollup(_both(spark, sf_dir))


@query("rank_for_user", "SO-2 RS-8", doubles(with_tables(
    "SELECT user_id, restaurant_id, tier, overall_risk, CAST(position AS INTEGER) AS position FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE tier WHEN 'avoid' THEN 2 WHEN 'caution' THEN 1 ELSE 0 END, overall_risk, "
    "overall_confidence DESC, quality DESC, restaurant_id) AS position FROM rolled)", **BOTH)))
def rank_for_user(spark, sf_dir):
    rolled = plan.rolled_with_quality(_both(spark, sf_dir, plan.rated(spark, sf_dir)))
    return risk.rank_for_user(rolled, F.col("quality")).select("user_id", "restaurant_id", "tier", "overall_risk", "position")


@query("ranked_restaurants", "RS-8")
def ranked_restaurants(spark, sf_dir):
    return plan.ranked_restaurants(spark, sf_dir)


def all_class_evidence(spark, sf_dir):
    rest = plan.restaurants(spark, sf_dir)
    none = F.lit(None).cast("array<string>")
    needs = rest.select("restaurant_id", F.lit("nuts|*").alias("class_key"), F.lit("nuts").alias("allergen"), none.alias("nut_types"), text_array(["peanuts", "tree_nuts"]).alias("families"))
    return risk.dish_evidence(dishes(spark, sf_dir), rest, needs, plan.AS_OF_YEAR)


FLAG_COLUMNS = "restaurant_id, parsed, risky, suspected, chart_hit, text_hit, cross_hit, chart, covers"


@query("evidence_flags", "AG-10", with_tables(f"SELECT {FLAG_COLUMNS}, round(CAST(top AS DOUBLE), 4) AS top_risk, round(CAST(trust AS DOUBLE), 4) AS trust FROM flags",
                                               **{k: v for k, v in NUT_TABLES.items() if k not in ("scored", "prefs", "comm", "pairs", "reviews")}))
def evidence_flags(spark, sf_dir):
    return risk.evidence_flags(all_class_evidence(spark, sf_dir)).select(
        *FLAG_COLUMNS.replace(" ", "").split(","), F.round("top_risk", 4).alias("top_risk"), F.round("trust", 4).alias("trust"))


_PER_DISH = f"SELECT restaurant_id, trim(item_name) AS name, max(prior_risk) AS prior, max(base_risk) AS base, bool_or({_NUTS_HIT} AND chart) AS ch, bool_or({_NUTS_HIT}) AS hit, bool_or(prior_basis = 'suspected_nuts') AS sus, min(arrival) AS arrival FROM {_NUT_ITEMS} GROUP BY ALL"


RISKIEST = (
    "SELECT restaurant_id, name, CAST(row_number() OVER (PARTITION BY restaurant_id ORDER BY CASE WHEN charted THEN pc ELSE pp END) AS INTEGER) AS position, CAST(CASE WHEN charted THEN 0.95 ELSE round(prior, 3) END AS DOUBLE) AS risk FROM (SELECT *, "
    "bool_or(ch) OVER (PARTITION BY restaurant_id) AS charted, row_number() OVER (PARTITION BY restaurant_id, ch ORDER BY arrival, name) AS pc, row_number() OVER (PARTITION BY restaurant_id ORDER BY prior DESC, arrival, name) AS pp "
    f"FROM ({_PER_DISH})) WHERE CASE WHEN charted THEN ch AND pc <= 8 ELSE pp <= 8 AND (hit OR sus OR prior >= greatest(0.5, base + 0.1)) END")


@query("riskiest_items", "WI-15", with_tables(RISKIEST, **{k: v for k, v in COMMON.items() if k not in ("pairs", "reviews")}))
def riskiest_items(spark, sf_dir):
    return risk.riskiest_items(all_class_evidence(spark, sf_dir)).select("restaurant_id", "name", "position", "risk")


@query("restaurant_risk_rollup", "AG-9", with_tables(
    "SELECT restaurant_id, round(greatest(max(base_risk), max(prior_risk)), 4) AS risk, CASE WHEN bool_or(prior_risk >= 0.5) THEN CAST(0.8 AS DOUBLE) ELSE 0.55 END AS confidence, count(*) FILTER (prior_risk >= 0.5) AS n_risky, "
    f"array_to_string(list_transform(list_sort(list(DISTINCT {{r: -prior_risk, n: item_name}}))[1:5], lambda s: s.n), '|') AS top FROM ({ITEM_PRIOR_SQL}) GROUP BY 1",
    **{k: v for k, v in COMMON.items() if k not in ("pairs", "reviews", "rest")}))
def restaurant_risk_rollup(spark, sf_dir):
    from dinesight.catalog.tagging_queries import scored_dishes
    from dinesight.operators.reports import restaurant_risk_rollup as rollup
    from dinesight.operators.tagging import item_prior
    rows = item_prior(scored_dishes(spark, sf_dir), text_array(["peanuts", "tree_nuts"]), F.lit(None).cast("array<string>"), F.col("cuisines"), F.col("region"))
    out = rollup(rows, F.col("cuisines"), F.col("region"))
    return out.select("restaurant_id", F.round("risk", 4).alias("risk"), "confidence", "n_risky", F.array_join("top_items", "|").alias("top"))


# --- Small pieces of the ladder -------------------------------------------------------
_C = "CAST(c_custkey % 100 AS DOUBLE) / 100"


@query("tier_and_pull_down", "RS-5 RS-6", doubles(
       "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND NOT c_custkey % 2 = 0 THEN 'avoid' WHEN c_custkey % 5 < 2 AND NOT c_custkey % 3 = 0 AND c_custkey % 4 >= 1 THEN 'avoid' WHEN c_custkey % 7 = 0 AND r >= 0.5 AND c_custkey % 4 >= 2 THEN 'avoid' "
       f"WHEN r >= 0.18 THEN 'caution' ELSE 'likely_ok' END AS tier, round(greatest(0.12, r * (1 - 0.7 * 0.75)), 4) AS pulled FROM (SELECT c_custkey, {_C} AS r FROM customer)"))
def tier_and_pull_down(spark, sf_dir):
    k = F.col("c_custkey")
    r = (k % 100) / 100.0
    tier = risk.tier_for(r, k % 4, F.lit(0.18), (k % 3 == 0) | (k % 5 < 2), k % 3 == 0, k % 2 == 0, k % 7 == 0)
    return table(spark, sf_dir, "customer").select("c_custkey", tier.alias("tier"), F.round(risk.pull_down(r, 0.75, F.lit(0.7), F.lit(0.12)), 4).alias("pulled"))


@query("community_weight", "AG-11", with_tables(
    f"SELECT restaurant_id, count(*) AS n, round(CAST(least(1.0, max({_W}) + 0.15 * (count(*) - 1)) AS DOUBLE), 4) AS weight FROM reviews WHERE type IN ('adverse_event', 'allergen_presence') GROUP BY 1", reviews=REVIEWS_SQL))
def community_weight(spark, sf_dir):
    rows = plan.reviews(spark, sf_dir).where(F.col("type").isin("adverse_event", "allergen_presence"))
    out = rows.groupBy("restaurant_id").agg(F.count("*").alias("n"), F.max(risk.community_strength(F.col("allergen"), F.col("age_days"))).alias("b"))
    return out.select("restaurant_id", "n", F.round(risk.community_weight(F.col("b"), F.col("n")), 4).alias("weight"))


@query("handling_rollup", "AG-12", with_tables(
    "SELECT r.restaurant_id, r.allergen_menu_available OR r.ask_staff OR r.allergy_disclaimer OR coalesce(g, 0) > 0 AS allergy_aware, r.cross_contact_warning, r.ask_staff, r.nut_free_claim, coalesce(g, 0) AS community_praise, coalesce(p, 0) AS community_concern "
    "FROM rest r LEFT JOIN (SELECT restaurant_id, count(*) FILTER (type = 'good_handling') AS g, count(*) FILTER (type = 'poor_handling') AS p FROM reviews GROUP BY 1) c USING (restaurant_id)",
    places=PLACES_SQL, rest=REST_SQL, reviews=REVIEWS_SQL))
def handling_rollup(spark, sf_dir):
    return risk.handling_rollup(plan.restaurants(spark, sf_dir), plan.reviews(spark, sf_dir))


@query("apply_community", "RS-4", doubles(
    "SELECT c_custkey, round(least(0.97, r + d), 4) AS risk, n_adv > 0 AND least(0.97, r + d) > r + 1e-9 AS reported FROM (SELECT *, CASE WHEN n_adv > 0 THEN least(0.25, 0.25 * least(1.0, 0.7 + 0.15 * (n_adv - 1))) ELSE 0 END + "
    f"CASE WHEN n_poor > 0 THEN least(0.05, 0.05 * least(1.0, 0.5 + 0.15 * (n_poor - 1))) ELSE 0 END AS d FROM (SELECT c_custkey, {_C} AS r, c_custkey % 4 AS n_adv, c_custkey % 3 AS n_poor FROM customer))"))
def apply_community(spark, sf_dir):
    k = F.col("c_custkey")
    s = risk.apply_community((k % 100) / 100.0, F.lit(0.5), k % 4, F.lit(0.7), k % 3, F.lit(0.5))
    return table(spark, sf_dir, "customer").select("c_custkey", s.alias("s")).select("c_custkey", F.round("s.risk", 4).alias("risk"), "s.reported")


_TERM_LISTS = [["Peanut butter", "milk"], ["tree nut"], ["coconut", "nutmeg"], ["mixed nuts"], ["marzipan", "pecan"], ["walnut oil"], ["may contain milk"]]


@query("per_nut_terms", "AG-31",
       "SELECT l_orderkey, l_linenumber, l_partkey, list_extract(['', 'tree nut', '', 'mixed nuts', 'marzipan', '', ''], i) AS contains, list_extract(['peanut butter', '', '', '', 'pecan', 'walnut oil', ''], i) AS other "
       "FROM (SELECT *, CAST(l_partkey % 7 AS INTEGER) + 1 AS i FROM lineitem)")
def per_nut_terms(spark, sf_dir):
    terms = F.element_at(F.array(*[text_array(v) for v in _TERM_LISTS]), (F.col("l_partkey") % 7 + 1).cast("int"))
    s = risk.split_nut_terms(risk.term_facts(terms), text_array(["tree_nuts"]), text_array(["almond", "pine_nut"]))
    lines = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"))
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", s.alias("s")).select(
        "l_orderkey", "l_linenumber", "l_partkey", F.array_join("s.contains", ",").alias("contains"), F.array_join("s.other", ",").alias("other"))


_NUT_LISTS = [["Almonds", "almond"], ["tree nuts"], ["pine", "Brazil Nut"], ["peanut", "tree-nut"], ["zzz"], ["pecan", "Pine Nut", "peanuts"]]


@query("normalize_nut_types", "PR-36",
       "SELECT c_custkey, list_extract(['almond', 'almond,brazil_nut,cashew,chestnut,hazelnut,macadamia,pecan,pine_nut,pistachio,walnut', 'brazil_nut,pine_nut', NULL, NULL, 'peanuts,pecan,pine_nut'], CAST(c_custkey % 6 AS INTEGER) + 1) AS nuts FROM customer")
def normalize_nut_types(spark, sf_dir):
    values = F.element_at(F.array(*[text_array(v) for v in _NUT_LISTS]), (F.col("c_custkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(risk.normalize_nut_types(values), ",").alias("nuts"))


_REQUESTS = ['{"severity":"anaphylaxis"}', '{"allergens":[{"allergen":"Dairy","severity":"intolerance"},{"allergen":"peanuts"}],"diets":["gluten_free"]}',
             '{"diets":["vegan"]}', '{"allergens":[{"allergen":"nuts","nutTypes":["pecan"],"crossContact":"strict"},{"allergen":"zzz"}]}']


@query("profile_from_request", "PR-35", """
    SELECT event_id AS user_id, pref_ord, allergen, severity, cross_contact, nuts FROM events, LATERAL (SELECT * FROM (VALUES
      (0, 0, 'nuts', 'anaphylaxis', NULL, NULL), (1, 0, 'milk', 'intolerance', NULL, NULL), (1, 1, 'peanut', 'allergy', NULL, NULL),
      (1, 2, 'gluten', 'allergy', NULL, NULL), (3, 0, 'nuts', 'allergy', 'strict', 'pecan')) v(m, pref_ord, allergen, severity, cross_contact, nuts) WHERE v.m = event_id % 4)""")
def profile_from_request(spark, sf_dir):
    requests = table(spark, sf_dir, "events").select(F.col("event_id").alias("user_id"), pick(_REQUESTS, F.col("event_id")).alias("request"))
    return risk.profile_from_request(requests).select("user_id", "pref_ord", "allergen", "severity", "cross_contact", F.array_join("nut_types", ",").alias("nuts"))


@query("apply_guardrails", "RS-9 JN-27",
       "SELECT c_custkey AS key, CASE WHEN NOT scored THEN tier WHEN grounded THEN tier ELSE list_extract(['likely_ok', 'caution', 'avoid'], CAST(least(mr, CASE WHEN reported THEN tr ELSE 1 END) AS INTEGER) + 1) END AS tier, "
       "CASE WHEN scored THEN round(greatest(CASE WHEN grounded THEN r ELSE 0.12 END, least(least(0.97, r + 0.2), m)), 3) ELSE r END AS risk FROM (SELECT c_custkey, c_custkey % 3 <> 0 AS scored, c_custkey % 2 = 0 AS grounded, c_custkey % 5 = 0 AS reported, "
       f"c_custkey % 3 AS tr, list_extract(['likely_ok', 'caution', 'avoid'], CAST(c_custkey % 3 AS INTEGER) + 1) AS tier, (c_custkey + 1) % 3 AS mr, {_C} AS r, CAST(c_custkey * 7 % 100 AS DOUBLE) / 100 AS m FROM customer)")
def apply_guardrails(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer")
    tiers = ["likely_ok", "caution", "avoid"]
    det = rows.select(k.alias("key"), pick(tiers, k).alias("tier"), ((k % 100) / 100.0).alias("risk"), F.lit(0.5).alias("confidence"),
                      F.when(k % 2 == 0, "allergen_matrix").otherwise("cuisine_prior").alias("basis"), F.lit("allergy").alias("severity"),
                      (k % 5 == 0).alias("community_reported"), text_array(["E1", "E2"]).alias("evidence_ids"))
    model = rows.where(k % 3 != 0).select(k.alias("key"), pick(tiers, k + 1).alias("model_tier"), ((k * 7 % 100) / 100.0).alias("model_risk"),
                                          F.lit(0.6).alias("model_confidence"), text_array(["E2", "E9"]).alias("cited_ids"))
    return risk.apply_guardrails(det, model).select("key", "tier", "risk")


@query("menu_label_scenario", "AG-30", with_tables(
    "SELECT restaurant_id, count(*) AS n_named, count(*) FILTER (contains(extraction_method, 'matrix')) AS n_charted, CASE WHEN count(*) FILTER (contains(extraction_method, 'matrix')) / CAST(count(*) AS DOUBLE) >= 0.6 THEN 'labeled' ELSE 'raw_menu' END AS scenario FROM dishes GROUP BY 1",
    dishes=DISHES_SQL))
def menu_label_scenario(spark, sf_dir):
    return risk.menu_label_scenario(dishes(spark, sf_dir))


@query("compact_menu", "WI-14", with_tables(
    "SELECT restaurant_id, CAST(position AS INTEGER) AS position, CASE WHEN len(allergen_terms) > 0 THEN item_name || ' [' || array_to_string(list_sort(list_distinct(allergen_terms)), ', ') || ']' ELSE item_name END AS line FROM "
    "(SELECT *, row_number() OVER (PARTITION BY restaurant_id ORDER BY arrival) AS position FROM (SELECT *, row_number() OVER (PARTITION BY restaurant_id, lower(item_name) ORDER BY arrival) AS rn FROM dishes) WHERE rn = 1)", dishes=DISHES_SQL))
def compact_menu(spark, sf_dir):
    return risk.compact_menu(dishes(spark, sf_dir))


# --- Diets -----------------------------------------------------------------------------------
_MEAT = {"meat": ["beef", "chicken"], "poultry": ["chicken"], "gelatin": ["marshmallow"], "honey": ["honey", "baklava"], "dairy": ["cheese", "butter"], "egg": ["egg"]}


def _diet_terms(spark):
    rows = [(cat, term) for cat, terms in _MEAT.items() for term in terms]
    return spark.createDataFrame(rows, "category string, term string")


def _conflict_sql(diet: str) -> str:
    from dinesight.vocab.allergens import DIET_EXCLUDED_ALLERGENS, DIET_EXCLUDED_CATEGORIES
    words = sorted({t for c in DIET_EXCLUDED_CATEGORIES[diet] for t in _MEAT[c]})
    return f"(list_has_any(allergen_terms, {sql_list(DIET_EXCLUDED_ALLERGENS[diet])}) OR len(list_filter({sql_list(words)}, lambda w: contains(lower(item_name), w))) > 0)"


def _diet_sql(diet: str, labels: list[str]) -> str:
    kinds = f"CASE WHEN arrival LIKE '%7' THEN 'ai' WHEN {_conflict_sql(diet)} THEN 'off' WHEN list_has_any(dietary_terms, {sql_list(labels)}) THEN 'lab' ELSE 'asm' END"
    return (f"SELECT restaurant_id, '{diet}' AS diet, count(*) AS total, count(*) FILTER (kd = 'lab') AS labeled, count(*) FILTER (kd = 'asm') AS assumed, count(*) FILTER (kd = 'ai') AS ai, count(*) FILTER (kd = 'off') AS off "
            f"FROM (SELECT *, {kinds} AS kd FROM dishes) GROUP BY 1")


DIET_SQL = (
    "SELECT restaurant_id, diet, CASE WHEN accommodated AND v0 = 'limited' THEN 'good_options' WHEN accommodated AND v0 = 'unknown' THEN 'limited' ELSE v0 END AS verdict, basis, support FROM (SELECT *, restaurant_id LIKE '%3' AS accommodated, "
    "CASE WHEN ok = 0 THEN CASE WHEN off = total THEN 'not_compatible' ELSE 'unknown' END WHEN ok / total >= 0.4 AND NOT (diet = 'vegan' AND assumed > 0 AND (labeled + ai) / total < 0.4) THEN 'good_options' ELSE 'limited' END AS v0, "
    "CASE WHEN ok = 0 THEN 'none' WHEN ai > 0 AND labeled + assumed = 0 THEN 'ai_assessed' WHEN ai > 0 OR (labeled > 0 AND assumed > 0) THEN 'mixed' WHEN labeled > 0 THEN 'labeled' ELSE 'estimated' END AS basis, "
    "CASE WHEN ok > 0 THEN round(ok / CAST(total AS DOUBLE), 2) ELSE 0 END AS support FROM (SELECT *, CAST(labeled + assumed + ai AS DOUBLE) AS ok FROM ("
    + _diet_sql("vegan", ["vegan", "plant-based", "plant based"]) + " UNION ALL " + _diet_sql("vegetarian", ["vegetarian", "vegan", "plant-based", "plant based"]) + ")))")


def judged_rows(spark, sf_dir):
    items = dishes(spark, sf_dir)
    judged = items.where(F.col("arrival").endswith("7")).select("restaurant_id", "arrival", F.explode(text_array(["vegan", "vegetarian"])).alias("diet"), F.lit("yes").alias("verdict"))
    return dt.judged_items(items, ["vegan", "vegetarian"], _diet_terms(spark), judged)


def diet_rows(spark, sf_dir, restaurants=None):
    accommodations = plan.restaurants(spark, sf_dir).where(F.col("restaurant_id").endswith("3")).select(
        "restaurant_id", F.explode(text_array(["vegan", "vegetarian"])).alias("diet"), F.lit("can be made vegan").alias("quote"))
    return dt.assess_diets(judged_rows(spark, sf_dir), accommodations, restaurants, ["vegan", "vegetarian"])


@query("diet_assessment", "AG-14", with_tables(
    "SELECT restaurant_id, diet, coalesce(verdict, 'unknown') AS verdict, coalesce(basis, 'none') AS basis, CAST(coalesce(support, 0) AS DOUBLE) AS support "
    "FROM (SELECT restaurant_id, unnest(['vegan', 'vegetarian']) AS diet FROM places) LEFT JOIN diets USING (restaurant_id, diet)", dishes=DISHES_SQL, places=PLACES_SQL, diets=DIET_SQL))
def diet_assessment(spark, sf_dir):
    return diet_rows(spark, sf_dir, places(spark, sf_dir)).select("restaurant_id", "diet", "verdict", "basis", "support")


def _diet_side_sql(diet: str, labels: list[str]) -> str:
    kind = f"CASE WHEN arrival LIKE '%7' THEN 1 WHEN {_conflict_sql(diet)} THEN 3 WHEN list_has_any(dietary_terms, {sql_list(labels)}) THEN 0 ELSE 2 END"
    return f"SELECT restaurant_id, '{diet}' AS diet, arrival, item_name, {kind} AS k FROM dishes"


@query("diet_dishes", "AG-14", with_tables(
    "SELECT restaurant_id, diet, side, CAST(position AS INTEGER) AS position, item_name FROM (SELECT *, row_number() OVER (PARTITION BY restaurant_id, diet, side ORDER BY k, arrival) AS position "
    "FROM (SELECT *, CASE WHEN k = 3 THEN 'offending' ELSE 'compatible' END AS side FROM (" + _diet_side_sql("vegan", ["vegan", "plant-based", "plant based"]) + " UNION ALL "
    + _diet_side_sql("vegetarian", ["vegetarian", "vegan", "plant-based", "plant based"]) + "))) WHERE position <= 10", dishes=DISHES_SQL))
def diet_dishes(spark, sf_dir):
    return dt.diet_dishes(judged_rows(spark, sf_dir))


@query("valid_judgments", "FI-15", with_tables(
    "SELECT restaurant_id, name, diet FROM (SELECT DISTINCT restaurant_id, lower(item_name) AS name FROM dishes), (SELECT unnest(['vegan', 'vegetarian']) AS diet) WHERE length(name) % 3 <> 0", dishes=DISHES_SQL))
def valid_judgments(spark, sf_dir):
    real = dishes(spark, sf_dir).select("restaurant_id", "item_name")
    raw = real.distinct().select("restaurant_id", F.upper("item_name").alias("item_name"), F.explode(text_array(["Vegan", "vegetarian", "keto"])).alias("diet"),
                                 F.when(F.length("item_name") % 3 == 0, "maybe").otherwise("YES").alias("verdict"), F.lit("0.7").alias("confidence"))
    return dt.valid_judgments(raw, real, ["vegan", "vegetarian"]).select("restaurant_id", F.col("item_name").alias("name"), "diet")


@query("diet_tiebreak", "SO-6", with_tables(
    "SELECT restaurant_id, CAST(row_number() OVER (ORDER BY risk, vr DESC, br DESC, restaurant_id) AS INTEGER) AS position FROM (SELECT r.restaurant_id, round(CAST(r.k % 10 AS DOUBLE) / 10, 1) AS risk, coalesce(min(CASE d.verdict WHEN 'good_options' THEN 3 "
    "WHEN 'limited' THEN 2 WHEN 'unknown' THEN 1 ELSE 0 END), -1) AS vr, coalesce(min(CASE d.basis WHEN 'labeled' THEN 4 WHEN 'ai_assessed' THEN 3 WHEN 'mixed' THEN 2 WHEN 'estimated' THEN 1 ELSE 0 END), -1) AS br FROM rest r LEFT JOIN diets d USING (restaurant_id) GROUP BY ALL) "
    "QUALIFY position <= 20", dishes=DISHES_SQL, places=PLACES_SQL, rest=REST_SQL, diets=DIET_SQL))
def diet_tiebreak(spark, sf_dir):
    cards = plan.restaurants(spark, sf_dir).select("restaurant_id", F.round((F.col("k") % 10) / 10.0, 1).alias("risk"))
    ordered = dt.diet_tiebreak(cards, diet_rows(spark, sf_dir), ["vegan", "vegetarian"], limit=20)
    return ordered.select("restaurant_id", "position")


