"""Per-user allergen risk: evidence per pref class, fusion ladder, roll-up, rank.

Users never meet dishes. Prefs collapse into (allergen, nut selection) classes;
dish evidence is rolled up once per restaurant and class, and the severity
ladder runs on that one row per (user, restaurant, pref).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dinesight.functions.literals import MAX_LITERAL_ENTRIES, contained_rows, contains_any, let, lookup, py_round, text_array
from dinesight.functions.text import blank_to_empty, has_value
from dinesight.functions.urls import absence_factor, labeling_trust, source_trust
from dinesight.operators.common import bounded_rows, grown, keep_first
from dinesight.operators.entities import at_home, boost_at_home, cuisine_prior
from dinesight.operators.tagging import (
    canonical_allergen, dish_hits, dish_text, generic_dish_prior, suspected_hits)
from dinesight.session import written
from dinesight.vocab import allergens as av
from dinesight.vocab import cuisines as cv
from dinesight.vocab import scoring as sv

NUT_KEYS = ["nuts", "peanuts", "tree_nuts"]
SIGNALS = ["nut_free_claim", "cross_contact_warning", "ask_staff", "allergen_menu_available", "allergy_disclaimer"]


# --- Prefs ------------------------------------------------------------------------
def normalize_nut_types(values: Column) -> Column:
    """Canonical sorted nut selection; null for none, unknown or all."""
    def one(raw: Column) -> Column:
        key = F.replace(F.lower(F.trim(raw)), F.lit("_"), F.lit(" "))
        name = F.coalesce(lookup(key, av.NUT_REQUEST_ALIASES), F.replace(key, F.lit(" "), F.lit("_")))
        return (F.when(name == "tree_nuts", text_array(av.TREE_NUT_TYPES)).when(name == "nuts", text_array(av.NUT_TYPES))
                .when(name.isin(av.NUT_TYPES), F.array(name)).otherwise(text_array([])))

    chosen = F.array_sort(F.array_distinct(F.flatten(F.transform(F.coalesce(values, text_array([])), lambda v: one(blank_to_empty(v))))))
    return let(chosen, lambda c: F.when((F.size(c) > 0) & (F.size(c) < len(av.NUT_TYPES)), c))


def pref_families(allergen: Column, nuts: Column) -> Column:
    """Nut families a pref touches; the allergen itself off the nut path."""
    both, tree, peanut = text_array(["peanuts", "tree_nuts"]), text_array(["tree_nuts"]), text_array(["peanuts"])
    has_tree, has_peanut = F.arrays_overlap(nuts, text_array(av.TREE_NUT_TYPES)), F.array_contains(nuts, "peanuts")
    selected = F.when(has_tree & has_peanut, both).when(has_tree, tree).when(has_peanut, peanut).otherwise(both)
    return F.when(~allergen.isin(NUT_KEYS), F.array(allergen)).when(nuts.isNotNull(), selected).when(
        allergen == "nuts", both).otherwise(F.array(allergen))


def profile_from_request(requests: DataFrame) -> DataFrame:
    """Request JSON -> one pref row per allergen, with defaults.

    ``requests`` holds user_id and request (JSON text). Gluten-free is a gluten
    pref; a request without allergens and diets is the nuts-only shape.
    """
    from dinesight.schemas import PROFILE_REQUEST
    r = F.from_json("request", PROFILE_REQUEST)
    staged = requests.select("user_id", r.alias("r"))
    entries = F.coalesce(F.col("r.allergens"), F.expr("CAST(array() AS ARRAY<STRUCT<allergen: STRING, severity: STRING, crossContact: STRING, nutTypes: ARRAY<STRING>>>)"))
    diets = F.transform(F.coalesce(F.col("r.diets"), text_array([])), lambda d: F.lower(d))
    gluten_free = F.array_contains(diets, "gluten_free")
    known_diet = F.exists(diets, lambda d: d.isin(list(av.DIET_LABELS)))

    def key_of(raw: Column) -> Column:
        low = F.lower(blank_to_empty(raw))
        return F.coalesce(canonical_allergen(blank_to_empty(raw)), F.when(low.isin(NUT_KEYS), low))

    def pref(allergen: Column, severity: Column, cross: Column, nuts: Column) -> Column:
        low = F.lower(blank_to_empty(severity))
        level = F.lower(blank_to_empty(cross))
        return F.struct(allergen.alias("allergen"), F.when(low.isin(list(sv.SEVERITY)), low).when(low == "preference", "avoid_preference").otherwise("allergy").alias("severity"),
                        F.when(level.isin(list(sv.CROSS_CONTACT)), level).alias("cross_contact"),
                        F.when(allergen == "nuts", normalize_nut_types(nuts)).alias("nut_types"))

    listed = F.filter(F.transform(entries, lambda e: pref(key_of(e.allergen), e.severity, e.crossContact, e.nutTypes)), lambda p: p.allergen.isNotNull())
    gluten = pref(F.lit("gluten"), F.lit("allergy"), F.lit(""), F.lit(None).cast("array<string>"))
    with_gluten = F.when(gluten_free & ~F.exists(listed, lambda p: p.allergen == "gluten"), F.concat(listed, F.array(gluten))).otherwise(listed)
    legacy = F.array(pref(F.lit("nuts"), F.col("r.severity"), F.col("r.crossContact"), F.col("r.nutTypes")))
    prefs = F.when((F.size(entries) == 0) & ~known_diet & ~gluten_free, legacy).otherwise(with_gluten)
    return staged.select("user_id", F.posexplode(prefs).alias("pref_ord", "p")).select("user_id", "pref_ord", "p.*")


def with_class(prefs: DataFrame) -> DataFrame:
    """Adds the evidence class of each pref."""
    families = pref_families(F.col("allergen"), F.col("nut_types"))
    return prefs.withColumn("families", families).withColumn(
        "class_key", F.concat_ws("|", "allergen", F.coalesce(F.array_join("nut_types", ","), F.lit("*"))))


# --- Term evidence ------------------------------------------------------------------
def term_facts(terms: Column) -> Column:
    """What each grounded term names: nut family, specific nuts, canonical keys."""
    def generic(t: Column) -> Column:
        rest = t
        for word in av.NUT_LOOKALIKES:
            rest = F.replace(rest, F.lit(word), F.lit(""))
        return t.isin(av.GENERIC_NUT_TERMS) | (t.contains("nut") & rest.contains("nut"))

    def facts(t: Column) -> Column:
        tree = contains_any(t, av.TREE_NUT_TERMS)
        named = F.array_compact(F.array(*[F.when(contains_any(t, av.NUT_TYPE_TERMS[n]), n) for n in av.TREE_NUT_TYPES]))
        # Only tree-nut terms are told apart.
        nuts = F.when(tree, named).otherwise(text_array([]))
        core = F.regexp_replace(F.replace(F.replace(t, F.lit("may contain"), F.lit("")), F.lit("traces"), F.lit("")), r"^[ :\-]+|[ :\-]+$", "")
        return F.struct(t.alias("term"), contains_any(t, av.PEANUT_TERMS).alias("peanut"), tree.alias("tree"),
                        generic(t).alias("generic"), nuts.alias("nuts"), canonical_allergen(core).alias("key"), canonical_allergen(t).alias("whole_key"),
                        contains_any(t, ["may contain", "traces", "trace of", "cross"]).alias("cross"))

    lows = F.filter(F.transform(F.coalesce(terms, text_array([])), lambda t: F.lower(F.trim(t))), lambda t: F.length(t) > 0)
    return F.transform(lows, facts)


def split_nut_terms(facts: Column, families: Column, nuts: Column) -> Column:
    """struct(contains, other): terms of the wanted nuts, and of other nuts."""
    def wanted(f: Column) -> Column:
        family = ((F.array_contains(families, "peanuts") & f.peanut) | (F.array_contains(families, "tree_nuts") & f.tree) | f.generic)
        tree = F.when(F.size(f.nuts) == 0, F.array_contains(families, "tree_nuts")).otherwise(F.arrays_overlap(f.nuts, nuts))
        chosen = F.when(f.peanut, F.array_contains(nuts, "peanuts")).when(f.tree, tree).otherwise(F.lit(True))
        return F.when(nuts.isNull(), family).otherwise(chosen)

    named = F.filter(facts, lambda f: f.peanut | f.tree | f.generic)
    none = text_array([])
    return F.struct(F.filter(named, wanted).term.alias("contains"),
                    F.when(nuts.isNull(), none).otherwise(F.filter(named, lambda f: ~wanted(f)).term).alias("other"))


def split_allergen_terms(facts: Column, allergen: Column) -> Column:
    """struct(contains, cross): terms of one allergen, and its trace warnings."""
    mine = F.filter(facts, lambda f: F.coalesce(f.key == allergen, F.lit(False)) | F.coalesce(f.whole_key == allergen, F.lit(False)))
    return F.struct(F.filter(mine, lambda f: ~f.cross).term.alias("contains"), F.filter(mine, lambda f: f.cross).term.alias("cross"))


# --- Evidence per restaurant and class ----------------------------------------------------
def _kb_literal(kb: DataFrame | Sequence[Mapping] | None):
    if kb is None:
        return []
    return bounded_rows(kb, MAX_LITERAL_ENTRIES) if isinstance(kb, DataFrame) else list(kb)


#: Bits of a mask: the nuts a text can name, what a nut term names as a whole, then the other allergens.
_NUT_BITS = {nut: 1 << i for i, nut in enumerate(av.NUT_TYPES)}
_FAMILY_BITS = {"peanuts": 1 << 11, "tree_nuts": 1 << 12}
_GENERIC, _UNNAMED_TREE, _ONLY_GENERIC = 1 << 13, 1 << 14, 1 << 15
_ALLERGEN_BITS = {key: 1 << (16 + i) for i, key in enumerate(av.ALLERGEN_FORMS)}


def _bit(value: Column, table: Mapping[str, int]) -> Column:
    return F.coalesce(lookup(value, table), F.lit(0))


def _any(flag: Column, bit: int) -> Column:
    return F.when(flag, bit).otherwise(0)


def _joined_bits(masks: Column) -> Column:
    """All bits of an array of masks; none for null."""
    return F.coalesce(F.aggregate(masks, F.lit(0), lambda acc, m: acc.bitwiseOR(m)), F.lit(0))


def _bits(values: Column, table: Mapping[str, int]) -> Column:
    return _joined_bits(F.transform(values, lambda v: _bit(v, table)))


def _nut_mask(f: Column) -> Column:
    """What one term names on the nut path; a peanut term counts for no tree nut of a selection."""
    tree = f.tree & ~f.peanut
    parts = [_any(f.peanut, _FAMILY_BITS["peanuts"]), _any(f.tree, _FAMILY_BITS["tree_nuts"]), _any(f.generic, _GENERIC),
             _any(tree & (F.size(f.nuts) == 0), _UNNAMED_TREE), F.when(tree, _bits(f.nuts, _NUT_BITS)).otherwise(0),
             _any(f.generic & ~f.peanut & ~f.tree, _ONLY_GENERIC)]
    return reduce(Column.bitwiseOR, parts)


def text_facts(items: DataFrame, kb: DataFrame | Sequence[Mapping] | None = None) -> DataFrame:
    """What each different dish text says, whoever serves it: ``text, claim, entries, suspects, dairy, kb_hits``."""
    texts = items.select(dish_text(F.col("item_name"), F.col("description")).alias("text")).distinct()
    none = F.expr("CAST(array() AS ARRAY<STRUCT<allergen: STRING, risk: DOUBLE, note: STRING>>)")
    rows = _kb_literal(kb)
    if rows is None:
        # A base too large to inline: equi-join, then at most one row per allergen and text.
        # The key is the text, never null, so a dish without a description finds its hits.
        dishes = texts.withColumns({"item_name": F.col("text"), "description": F.lit(None).cast("string")})
        hits = generic_dish_prior(dishes, kb, ["text"]).groupBy("text").agg(F.collect_list(F.struct("allergen", "risk", "note")).alias("kb_hits"))
        texts = texts.join(hits, "text", "left").withColumn("kb_hits", F.coalesce("kb_hits", none))
    elif rows:
        found = F.filter(contained_rows(F.col("text"), rows, "pattern", "allergen string, pattern string, risk double, note string, ord int"), lambda r: r.risk > 0)
        texts = texts.withColumn("kb_hits", F.transform(found, lambda r: F.struct(r.allergen.alias("allergen"), r.risk.alias("risk"), r.note.alias("note"))))
    else:
        texts = texts.withColumn("kb_hits", none)
    text = F.col("text")
    entries = F.array_distinct(F.transform(dish_hits(text), lambda r: F.struct(
        _bits(r.families, _FAMILY_BITS).alias("families"), _bits(r.nuts, _NUT_BITS).alias("nuts"), r.risk.alias("risk"))))
    return texts.select("text", contains_any(text, av.NUT_FREE_CLAIMS).alias("claim"), entries.alias("entries"),
                        _joined_bits(F.transform(suspected_hits(text), lambda r: _bits(r.families, _FAMILY_BITS))).alias("suspects"),
                        contains_any(text, cv.VEGAN_SUSPECTED).alias("dairy"), "kb_hits")


def term_masks(items: DataFrame) -> DataFrame:
    """What each different set of grounded terms names: ``terms, hit, cross, covered, nut_terms``.

    ``nut_terms`` keeps the masks of single nut terms, for terms that name none of the wanted nuts.
    """
    sets = items.select(_term_sets().alias("terms")).distinct()
    facts = sets.select("terms", term_facts(F.col("terms.own")).alias("own"), term_facts(F.col("terms.cross")).alias("other"))

    def keys(f: Column) -> Column:
        return _bit(f.key, _ALLERGEN_BITS).bitwiseOR(_bit(f.whole_key, _ALLERGEN_BITS))

    def named(array: str, cross: bool) -> Column:
        return _joined_bits(F.transform(F.filter(array, lambda f: f.cross if cross else ~f.cross), keys))

    nut_terms = F.array_sort(F.array_distinct(F.filter(F.transform("own", _nut_mask), lambda m: m != 0)))
    columns = F.col("terms.columns")
    covered = _joined_bits(F.transform(columns, lambda t: _bit(canonical_allergen(t), _ALLERGEN_BITS))).bitwiseOR(
        _any(F.array_contains(columns, "peanut"), _FAMILY_BITS["peanuts"])).bitwiseOR(_any(F.array_contains(columns, "tree nut"), _FAMILY_BITS["tree_nuts"]))
    return facts.select("terms", _joined_bits(nut_terms).bitwiseOR(named("own", False)).alias("hit"),
                        _joined_bits(F.transform("other", _nut_mask)).bitwiseOR(named("own", True)).bitwiseOR(named("other", False)).alias("cross"),
                        covered.alias("covered"), nut_terms.alias("nut_terms"))


def _term_sets() -> Column:
    empty = text_array([])
    return F.struct(F.coalesce("allergen_terms", empty).alias("own"), F.coalesce("cross_contact_terms", empty).alias("cross"),
                    F.coalesce("matrix_allergen_columns", empty).alias("columns"))


def dish_signatures(items: DataFrame, kb: DataFrame | Sequence[Mapping] | None = None) -> DataFrame:
    """One row per restaurant and dish name: masks of what its rows name, before any pref is known.

    Texts and term sets are read once each, however many restaurants share them; copies of a dish combine map-side.
    """
    arrival = F.col("arrival") if "arrival" in items.columns else F.lit(None).cast("string")
    method = F.lower(blank_to_empty(F.col("extraction_method")))
    rows = items.select("restaurant_id", F.trim(blank_to_empty(F.col("item_name"))).alias("name"), dish_text(F.col("item_name"), F.col("description")).alias("text"),
                        method.contains("matrix").alias("chart"), (method != "community_mention").alias("menu"), _term_sets().alias("terms"), arrival.alias("arrival"))
    # Menus repeat their words: few different texts and term sets are sent to the dishes, many are joined by shuffles.
    rows = rows.join(written(text_facts(items, kb)), "text").join(written(term_masks(items)), "terms")
    named, chart = F.length("name") > 0, F.col("chart")
    prior = F.struct(F.when(named, F.col("claim")).alias("claim"), F.when(named, F.col("entries")).alias("entries"), F.when(named, F.col("suspects")).alias("suspects"),
                     F.when(named, F.col("dairy")).alias("dairy"), F.transform("kb_hits", lambda h: F.struct(h.allergen.alias("allergen"), h.risk.alias("risk"))).alias("kb"))
    return rows.groupBy("restaurant_id", "name").agg(
        F.count_if(named & F.col("menu")).alias("parsed"), F.min("arrival").alias("arrival"), F.bool_or("chart").alias("chart"),
        F.bit_or(F.when(chart & named, F.col("hit")).otherwise(0)).alias("chart_mask"), F.bit_or(F.when(~chart & named, F.col("hit")).otherwise(0)).alias("text_mask"),
        F.bit_or(F.when(named, F.col("cross")).otherwise(0)).alias("cross_mask"), F.bit_or(F.when(chart, F.col("covered")).otherwise(0)).alias("cover_mask"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("nut_terms")))).alias("nut_terms"), F.array_sort(F.collect_set(prior)).alias("priors"))


def _class_base(cuisines: Column, region: Column, allergen: Column, baselines: Mapping[str, Mapping[str, float]]) -> Column:
    """struct(risk, confidence) of a class before any menu is read."""
    nut = cuisine_prior(cuisines, region)
    generic = None
    for key, table in baselines.items():
        default = table.get("_default", sv.GENERIC_DEFAULT)
        best = F.array_max(F.transform(cuisines, lambda c: F.coalesce(lookup(c, {k: v for k, v in table.items() if k != "_default"} or {"": 0.0}), F.lit(default))))
        value = F.greatest(F.lit(default), F.coalesce(best, F.lit(default)))
        generic = F.when(allergen == key, value) if generic is None else generic.when(allergen == key, value)
    base = F.lit(sv.GENERIC_DEFAULT) if generic is None else generic.otherwise(sv.GENERIC_DEFAULT)
    boosted = F.least(F.lit(cv.MAX_RISK), boost_at_home(base, cuisines, region, 0.25))
    is_nut = allergen.isin(NUT_KEYS)
    return F.struct(F.when(is_nut, nut["risk"]).otherwise(boosted).alias("risk"), F.when(is_nut, nut["confidence"]).otherwise(0.5).alias("confidence"))


_SIGNATURE = ["chart", "chart_mask", "text_mask", "cross_mask", "cover_mask", "nut_terms", "priors"]


def _class_masks(families: Column, nuts: Column, allergen: Column) -> Column:
    """struct(hit, cover, families, nuts): the bits that a class looks for."""
    is_nut, own = allergen.isin(NUT_KEYS), _bit(allergen, _ALLERGEN_BITS)
    wanted = _bits(families, _FAMILY_BITS)
    selected = (_any(F.array_contains(nuts, "peanuts"), _FAMILY_BITS["peanuts"]).bitwiseOR(_any(F.array_contains(families, "tree_nuts"), _UNNAMED_TREE))
                .bitwiseOR(_bits(F.filter(nuts, lambda n: n != "peanuts"), _NUT_BITS)).bitwiseOR(F.lit(_ONLY_GENERIC)))
    hit = F.when(~is_nut, own).when(nuts.isNull(), wanted.bitwiseOR(F.lit(_GENERIC))).otherwise(selected)
    return F.struct(hit.alias("hit"), F.when(is_nut, wanted).otherwise(own).alias("cover"), wanted.alias("families"), _bits(nuts, _NUT_BITS).alias("nuts"))


def _tested(rows: DataFrame, items: DataFrame, restaurants: DataFrame, needs: DataFrame, as_of_year: int,
            baselines: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """The masks of ``rows`` tested against the classes that users of the restaurant need."""
    places = restaurants.select("restaurant_id", "cuisines", "region", "official_domain", at_home(F.col("cuisines"), F.col("region")).alias("_home"),
                                F.coalesce(F.arrays_overlap("cuisines", text_array(["vegan", "vegetarian"])), F.lit(False)).alias("_plant"))
    charts = items.where(F.lower(blank_to_empty(F.col("extraction_method"))).contains("matrix")).select("restaurant_id", F.col("menu_source_url").alias("url")).distinct()
    trust = charts.join(grown(places.select("restaurant_id", "official_domain")), "restaurant_id").groupBy("restaurant_id").agg(
        F.min(source_trust(F.col("url"), F.col("official_domain"), as_of_year)).alias("trust"))
    classes = needs.join(grown(places.drop("official_domain")), "restaurant_id").join(grown(trust), "restaurant_id", "left").select(
        "restaurant_id", "class_key", "allergen", "_home", "trust", F.col("allergen").isin(NUT_KEYS).alias("is_nut"), F.col("nut_types").isNotNull().alias("selects"),
        (F.col("_plant") & F.array_contains("families", "tree_nuts")).alias("_plant"), _class_masks(F.col("families"), F.col("nut_types"), F.col("allergen")).alias("c"),
        _class_base(F.col("cuisines"), F.col("region"), F.col("allergen"), baselines)["risk"].alias("base_risk"))
    pairs = rows.join(grown(classes), "restaurant_id")

    def meets(mask: Column | str, bits: Column) -> Column:
        return (F.col(mask) if isinstance(mask, str) else mask).bitwiseAND(bits) != 0

    def boosted(risk: Column) -> Column:
        return F.least(F.lit(cv.MAX_RISK), F.when(F.col("_home"), risk * 1.10).otherwise(risk))

    def wanted(e: Column) -> Column:
        return meets(e.families, F.col("c.families")) & (~F.col("selects") | (e.nuts == 0) | meets(e.nuts, F.col("c.nuts")))

    def dish_risk(p: Column) -> Column:
        return F.array_max(F.transform(F.filter(p.entries, wanted), lambda e: e.risk))

    def hidden(p: Column) -> Column:
        return meets(p.suspects, F.col("c.families")) | (F.col("_plant") & p.dairy)

    def nut_prior(p: Column) -> Column:
        base = F.col("base_risk")
        known = let(dish_risk(p), lambda risk: F.when(risk.isNotNull(), boosted(risk)))
        return F.when(p.claim.isNotNull(), F.when(p.claim, 0.08).otherwise(
            F.coalesce(known, F.when(hidden(p), F.greatest(base, F.lit(cv.SUSPECTED_RISK))).otherwise(base))))

    def kb_prior(p: Column) -> Column:
        return boosted(F.array_max(F.transform(F.filter(p.kb, lambda h: h.allergen == F.col("allergen")), lambda h: h.risk)))

    is_nut = F.col("is_nut")
    prior = F.when(is_nut, F.array_max(F.transform("priors", nut_prior))).otherwise(F.array_max(F.transform("priors", kb_prior)))
    suspected = is_nut & F.exists("priors", lambda p: F.coalesce(~p.claim & dish_risk(p).isNull() & hidden(p), F.lit(False)))
    flags = pairs.withColumns({
        "chart_hit": meets("chart_mask", F.col("c.hit")), "text_hit": meets("text_mask", F.col("c.hit")), "cross_hit": meets("cross_mask", F.col("c.hit")),
        "covers": meets("cover_mask", F.col("c.cover")), "prior_risk": prior, "suspected": suspected,
        "other_nuts": is_nut & F.col("selects") & F.exists("nut_terms", lambda m: m.bitwiseAND(F.col("c.hit")) == 0)})
    return flags.withColumn("risky", F.col("chart_hit") | F.col("text_hit") | F.coalesce(
        F.col("prior_risk") >= F.greatest(F.lit(0.5), F.col("base_risk") + 0.1), F.lit(False))).drop(
        "c", "is_nut", "selects", "allergen", "_home", "_plant", "chart_mask", "text_mask", "cross_mask", "cover_mask", "nut_terms", "priors")


def dish_evidence(items: DataFrame, restaurants: DataFrame, needs: DataFrame, as_of_year: int, kb=None,
                  baselines: Mapping[str, Mapping[str, float]] = sv.GENERIC_BASELINES) -> DataFrame:
    """One row per restaurant, class and dish name: which evidence it gives.

    ``needs`` holds restaurant_id and the class columns.
    """
    return _tested(dish_signatures(items, kb), items, restaurants, needs, as_of_year, baselines)


def class_flags(items: DataFrame, restaurants: DataFrame, needs: DataFrame, as_of_year: int, kb=None,
                baselines: Mapping[str, Mapping[str, float]] = sv.GENERIC_BASELINES) -> DataFrame:
    """Evidence of every class at a restaurant: ``evidence_flags`` without a row per class and dish.

    Dishes of a restaurant that say the same become one row with their number, and only those meet the classes.
    """
    alike = dish_signatures(items, kb).groupBy("restaurant_id", (F.length("name") > 0).alias("_named"), *_SIGNATURE).agg(
        F.sum("parsed").alias("parsed"), F.count("*").alias("names")).withColumn("name", F.when(F.col("_named"), "*").otherwise(""))
    return evidence_flags(_tested(alike.drop("_named"), items, restaurants, needs, as_of_year, baselines))


def evidence_flags(evidence: DataFrame) -> DataFrame:
    """Dish evidence rolled up to one row per restaurant and class; a row stands for ``names`` dishes, or for one."""
    names = F.col("names") if "names" in evidence.columns else F.lit(1).cast("bigint")

    def dishes(flag: Column) -> Column:
        return F.sum(F.when(flag, names).otherwise(0))

    return evidence.groupBy("restaurant_id", "class_key").agg(
        F.sum("parsed").alias("parsed"), dishes(F.col("prior_risk").isNotNull() & (F.length("name") > 0)).alias("n_details"),
        F.max("prior_risk").alias("top_risk"), dishes(F.col("risky")).alias("risky"), dishes(F.col("suspected") & ~F.col("risky")).alias("suspected"),
        F.bool_or("chart_hit").alias("chart_hit"), F.bool_or("text_hit").alias("text_hit"), F.bool_or("cross_hit").alias("cross_hit"),
        F.bool_or("chart").alias("chart"), F.bool_or("covers").alias("covers"), F.min("trust").alias("trust"), F.bool_or("other_nuts").alias("other_nuts"))


def riskiest_items(evidence: DataFrame, limit: int = 8) -> DataFrame:
    """The first chart-confirmed dishes of a class as they came; without any, those of the riskiest ``limit`` that are named or suspected."""
    kinds = F.array_compact(F.array(F.when(F.col("chart_hit"), "chart"), F.when(F.col("prior_risk").isNotNull(), "prior")))
    rows = evidence.where(F.length("name") > 0).withColumn("_kind", F.explode(kinds))
    keys = ["restaurant_id", "class_key"]
    top = keep_first(rows, [*keys, "_kind"], [F.when(F.col("_kind") == "prior", -F.col("prior_risk")).otherwise(0.0), F.asc("arrival"), F.asc("name")], limit, rank="_rank")
    # At most two times ``limit`` rows a class are left.
    charted = F.bool_or(F.col("_kind") == "chart").over(Window.partitionBy(*keys))
    shown = top.withColumn("_charted", charted).where(F.when(F.col("_charted"), F.col("_kind") == "chart").otherwise(F.col("risky") | F.col("suspected")))
    risk = F.when(F.col("_charted"), 0.95).otherwise(F.round("prior_risk", 3))
    position = F.row_number().over(Window.partitionBy(*keys).orderBy("_rank"))
    return shown.select(*keys, position.alias("position"), "name", risk.alias("risk"), (~F.col("_charted") & F.col("suspected") & ~F.col("risky")).alias("is_suspected"))


# --- Community ---------------------------------------------------------------------------
def community_strength(allergen: Column, age_days: Column) -> Column:
    """Strength of one report: named allergen, decayed by age."""
    base = F.when(has_value(allergen), 0.7).otherwise(0.5)
    return base * F.when(age_days.isNull() | (age_days <= 365), 1.0).when(age_days <= 730, 0.6).otherwise(0.3)


def community_weight(best: Column, n: Column) -> Column:
    """Strength of agreeing reports together."""
    return F.least(F.lit(1.0), best + (n - 1) * 0.15)


def community_rollup(community: DataFrame) -> DataFrame:
    """Per restaurant: adverse reports by allergen, poor and good handling.

    Reports aggregate before anything else, so a much-reviewed place is one row.
    """
    known = [*av.ALLERGEN_FORMS, *NUT_KEYS]
    allergen = F.when(has_value(F.col("allergen")), F.when(F.col("allergen").isin(known), F.col("allergen")).otherwise("other")).otherwise("")
    kind = F.when(F.col("type").isin("adverse_event", "allergen_presence"), "adverse").when(F.col("type") == "poor_handling", "poor").when(
        F.col("type") == "good_handling", "good")
    grouped = community.select("restaurant_id", kind.alias("kind"), allergen.alias("allergen"),
                               community_strength(F.col("allergen"), F.col("age_days")).alias("w")).where("kind IS NOT NULL").groupBy(
        "restaurant_id", "kind", "allergen").agg(F.count("*").alias("n"), F.max("w").alias("best"))
    return grouped.groupBy("restaurant_id").agg(
        F.collect_list(F.when(F.col("kind") == "adverse", F.struct("allergen", "n", "best"))).alias("adverse"),
        F.sum(F.when(F.col("kind") == "poor", F.col("n"))).alias("n_poor"), F.max(F.when(F.col("kind") == "poor", F.col("best"))).alias("best_poor"),
        F.coalesce(F.sum(F.when(F.col("kind") == "good", F.col("n"))), F.lit(0)).alias("community_praise"),
        F.coalesce(F.sum(F.when(F.col("kind") == "poor", F.col("n"))), F.lit(0)).alias("community_concern"))


def handling_rollup(restaurants: DataFrame, community: DataFrame) -> DataFrame:
    """Allergy-handling view of every restaurant, apart from dish risk."""
    joined = restaurants.join(community_rollup(community), "restaurant_id", "left")
    praise, concern = (F.coalesce(c, F.lit(0)) for c in ("community_praise", "community_concern"))
    aware = F.col("allergen_menu_available") | F.col("ask_staff") | F.col("allergy_disclaimer") | (praise > 0)
    return joined.select("restaurant_id", aware.alias("allergy_aware"), "cross_contact_warning", "ask_staff", "nut_free_claim",
                         praise.alias("community_praise"), concern.alias("community_concern"))


def apply_community(risk: Column, confidence: Column, n_adverse: Column, best_adverse: Column, n_poor: Column, best_poor: Column) -> Column:
    """struct(risk, confidence, reported): reports raise risk, never lower it."""
    adverse, poor = F.coalesce(n_adverse, F.lit(0)), F.coalesce(n_poor, F.lit(0))
    delta = (F.when(adverse > 0, F.least(F.lit(0.25), community_weight(best_adverse, adverse) * 0.25)).otherwise(0.0)
             + F.when(poor > 0, F.least(F.lit(0.05), community_weight(best_poor, poor) * 0.05)).otherwise(0.0))
    raised = clamp(risk + delta)
    sure = F.when(adverse > 0, F.greatest(confidence, F.least(F.lit(0.6), F.lit(0.3) + adverse * 0.1))).otherwise(confidence)
    return F.struct(raised.alias("risk"), sure.alias("confidence"), ((adverse > 0) & (raised > risk + 1e-9)).alias("reported"))


def clamp(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(cv.MAX_RISK), value))


def pull_down(risk: Column, strength: float, trust: Column, floor: Column) -> Column:
    """A clean signal lowers risk by its strength and trust, never below the floor."""
    return F.greatest(floor, risk * (F.lit(1.0) - trust * strength))


def tier_for(risk: Column, severity_rank: Column, caution: Column, presence: Column, chart_hit: Column, navigable: Column, reported: Column) -> Column:
    """Five-rule tier ladder: evidence outranks inference."""
    return (F.when(chart_hit & ~navigable, "avoid").when(presence & ~chart_hit & (severity_rank >= 1), "avoid")
            .when(reported & (risk >= 0.5) & (severity_rank >= 2), "avoid").when(risk >= caution, "caution").otherwise("likely_ok"))


# --- The ladder ----------------------------------------------------------------------------
def fuse(facts: DataFrame, keys: Sequence[str], with_rationale: bool = False, with_reasons: bool = False) -> DataFrame:
    """Severity ladder over one row per restaurant and pref; ``keys`` are the columns of ``facts`` that name the row.

    ``with_reasons`` adds every step that spoke, in its order: ``reasons``, an array of (code, n, total) with the dishes counted.
    """
    def tuned(i: int) -> Column:
        return lookup(F.col("severity"), {k: v[i] for k, v in sv.SEVERITY.items()})

    level = F.coalesce("cross_contact", tuned(3))
    df = facts.withColumns({
        "severity_rank": tuned(0), "caution": tuned(1), "floor": tuned(2), "_level": level, "_is_nut": F.col("allergen").isin(NUT_KEYS),
        "_label": labeling_trust(F.col("region")), "_absence": absence_factor(F.col("region")),
        **{c: F.coalesce(c, F.lit(0)) for c in ("parsed", "n_details", "risky", "suspected")},
        **{c: F.coalesce(c, F.lit(False)) for c in ("chart_hit", "text_hit", "cross_hit", "chart", "covers", "other_nuts", *SIGNALS)},
        "trust": F.coalesce("trust", F.lit(1.0))})
    top = F.coalesce("top_risk", F.lit(0.0))
    has_details = F.col("n_details") > 0
    df = df.withColumns({
        "_floor_risk": F.col("base.risk"), "_strict": F.col("_level") == "strict", "_presence": F.col("chart_hit") | F.col("text_hit"),
        "_text_only": F.col("text_hit") & ~F.col("chart_hit"), "_safe": F.greatest(F.lit(0), F.col("parsed") - F.col("risky")),
        "_share": F.when(F.col("parsed") > 0, F.col("risky") / F.col("parsed")).otherwise(0.0),
        "_sshare": F.when(F.col("parsed") > 0, F.col("suspected") / F.col("parsed")).otherwise(0.0),
        "_r0": clamp(F.when(has_details, F.greatest(F.col("base.risk"), top)).otherwise(F.col("base.risk"))),
        "_c0": F.when(~has_details, F.col("base.confidence")).when(~F.col("_is_nut"), 0.6).when(top >= 0.5, 0.8).otherwise(0.55),
        "_b0": F.when(has_details & (top >= 0.5), "dish_prior").otherwise("cuisine_prior")})
    df = df.withColumn("_pervasive", (F.col("parsed") > 0) & (F.col("_share") >= sv.PERVASIVE_SHARE))
    df = df.withColumn("navigable", (F.col("risky") > 0) & (F.col("_safe") >= 3) & ~F.col("_pervasive") & ~F.col("_strict"))
    aware = F.col("allergy_disclaimer") | F.col("ask_staff") | F.col("allergen_menu_available")
    nav = F.lit(sv.NAV_BASE) + F.col("_share") * sv.NAV_SLOPE + F.col("_sshare") * sv.NAV_SUSPECTED_SLOPE
    nav = F.when(F.col("chart_hit"), nav * sv.NAV_CHART_FACTOR).when(F.col("_text_only"), nav).otherwise(
        F.greatest(nav, F.col("_floor_risk") * sv.NAV_INFERRED_RETAIN))
    nav = F.when(aware, nav * sv.NAV_HANDLING_FACTOR).otherwise(nav)
    hidden = F.lit(sv.SUSPECTED_BASE) + F.col("_sshare") * sv.NAV_SUSPECTED_SLOPE
    navigable, only_suspected, risky = F.col("navigable"), (F.col("risky") == 0) & (F.col("suspected") > 0), F.col("risky") > 0
    r, c, b = F.col("_r0"), F.col("_c0"), F.col("_b0")
    df = df.withColumns({
        "_r1": F.when(navigable, F.greatest(F.col("caution"), F.least(r, nav)))
        .when(only_suspected, F.when(F.col("_strict"), F.greatest(r, F.lit(0.5))).otherwise(F.greatest(F.col("caution"), F.least(r, hidden))))
        .when(risky & F.col("chart_hit"), F.greatest(r, F.lit(0.9))).when(risky & F.col("_text_only"), F.greatest(r, F.lit(0.8))).otherwise(r),
        "_c1": F.when(navigable, F.greatest(c, F.when(F.col("chart_hit"), 0.8).otherwise(0.6))).when(only_suspected, F.least(c, F.lit(sv.SUSPECTED_CONFIDENCE_CAP)))
        .when(risky & F.col("chart_hit"), F.greatest(c, F.lit(0.9))).when(risky & F.col("_text_only"), F.greatest(c, F.lit(0.7))).otherwise(c),
        "_b1": F.when(only_suspected, "suspected_nuts").when(~risky, b).when(F.col("chart_hit"), "allergen_matrix")
        .when(F.col("_text_only"), "menu_evidence").otherwise("dish_prior")})
    # Clean down-signals apply only when nothing was found present.
    r, c, b = F.col("_r1"), F.col("_c1"), F.col("_b1")
    clean_chart = ~F.col("_presence") & F.col("chart") & F.col("covers")
    claim = ~F.col("_presence") & ~clean_chart & F.col("nut_free_claim") & F.col("_is_nut")
    coverage = F.least(F.lit(1.0), F.col("parsed") / sv.COVERAGE_FULL)
    lowered = F.greatest(F.col("floor"), r * (F.lit(1.0) - coverage * F.col("_absence") * sv.COVERAGE_DISCOUNT))
    read = ~F.col("_presence") & ~clean_chart & ~claim & (b == "cuisine_prior") & (F.col("parsed") > 0) & (lowered < r)
    df = df.withColumns({
        "_r2": F.when(clean_chart, pull_down(r, 0.75, F.col("_label") * F.col("trust"), F.col("floor")))
        .when(claim, pull_down(r, 0.5, F.col("_label"), F.col("floor"))).when(read, lowered).otherwise(r),
        "_c2": F.when(clean_chart, F.greatest(c, F.col("trust") * 0.8)).when(claim, F.greatest(c, F.lit(0.6)))
        .when(read, F.greatest(c, F.lit(0.5) + coverage * 0.2)).otherwise(c),
        "_b2": F.when(clean_chart, "allergen_matrix").when(claim & (b == "cuisine_prior"), "restaurant_signal").when(read, "menu_coverage").otherwise(b)})
    warned = F.col("cross_contact_warning") | F.col("cross_hit")
    cc_floor = lookup(F.col("_level"), {k: v[0] for k, v in sv.CROSS_CONTACT.items()})
    bump = lookup(F.col("_level"), {k: v[1] for k, v in sv.CROSS_CONTACT.items()})
    df = df.withColumns({"_r3": F.when(warned, F.greatest(F.col("_r2"), cc_floor)).otherwise(F.col("_r2")),
                         "_b3": F.when(warned & (cc_floor > 0) & (F.col("_b2") == "cuisine_prior"), "restaurant_signal").otherwise(F.col("_b2"))})
    bumped = F.least(clamp(F.col("_r3") + bump), F.lit(sv.OTHER_NUT_CEILING))
    other = F.col("_is_nut") & F.col("nut_types").isNotNull() & F.col("other_nuts") & ~F.col("_presence") & (bumped > F.col("_r3"))
    df = df.withColumns({"_r4": F.when(other, bumped).otherwise(F.col("_r3")), "_c4": F.when(other, F.greatest(F.col("_c2"), F.lit(0.4))).otherwise(F.col("_c2"))})
    families = F.col("families")
    mine = F.filter(F.coalesce("adverse", F.expr("CAST(array() AS ARRAY<STRUCT<allergen: STRING, n: BIGINT, best: DOUBLE>>)")), lambda a: (a.allergen == "") | F.when(
        a.allergen == "nuts", F.arrays_overlap(families, text_array(["peanuts", "tree_nuts"]))).otherwise(F.array_contains(families, a.allergen)))
    df = df.withColumn("_mine", mine)
    df = df.withColumn("_s", apply_community(F.col("_r4"), F.col("_c4"), F.aggregate("_mine", F.lit(0).cast("bigint"), lambda acc, a: acc + a.n),
                                             F.array_max(F.transform("_mine", lambda a: a.best)), F.col("n_poor"), F.col("best_poor")))
    tier = tier_for(F.col("_s.risk"), F.col("severity_rank"), F.col("caution"), F.col("_presence"), F.col("chart_hit"), F.col("navigable"), F.col("_s.reported"))
    def reason(code: str, holds: Column, n: Column | None = None, total: Column | None = None) -> Column:
        return F.when(holds, F.struct(F.lit(code).alias("code"), *[(F.lit(None) if c is None else c).cast("bigint").alias(name) for name, c in (("n", n), ("total", total))]))

    n_risky, n_suspected, n_parsed = F.col("risky"), F.col("suspected"), F.col("parsed")
    spared = F.col("_strict") & (F.col("_safe") >= 3) & ~F.col("_pervasive")
    reasons = F.array_compact(F.array(
        reason("avoid_flagged_dishes", navigable, n_risky, n_parsed), reason("some_types_may_hide_it", navigable & (n_suspected > 0), n_suspected, n_parsed),
        reason("handles_allergies", navigable & aware), reason("only_types_that_may_hide_it", ~navigable & only_suspected, n_suspected, n_parsed),
        reason("traces_matter_to_this_diner", ~navigable & risky & spared, F.col("_safe"), n_parsed), reason("across_the_menu", ~navigable & risky & ~spared, n_risky, n_parsed),
        reason("chart_does_not_list_it", clean_chart), reason("nut_free_claim", claim), reason("menu_does_not_name_it", read, n_parsed, n_parsed),
        reason("chart_from_elsewhere", F.col("chart") & F.col("covers") & (F.col("trust") < 0.85)), reason("cross_contact_warning", warned & (F.col("_r2") < cc_floor)),
        reason("other_nuts_in_kitchen", F.coalesce(other, F.lit(False))), reason("diners_reported_it", F.col("_s.reported"))))
    out = df.withColumns({"risk": py_round(clamp(F.col("_s.risk")), 3), "confidence": py_round(F.col("_s.confidence"), 2), "tier": tier, "basis": F.col("_b3"),
                          "community_reported": F.col("_s.reported"), "menu_total": F.col("parsed"), "menu_flagged": F.col("risky"), "menu_suspected": F.col("suspected")})
    columns = [*keys, "risk", "confidence", "tier", "basis", "community_reported", "menu_total", "menu_flagged", "menu_suspected", "navigable"]
    if with_rationale:
        out = out.withColumn("rationale", rationale_text(F.col("tier"), F.col("basis"), nut_label(F.col("allergen"), F.col("nut_types")),
                                                         F.col("menu_flagged"), F.col("menu_total"), F.col("navigable")))
        columns.append("rationale")
    if with_reasons:
        out = out.withColumn("reasons", reasons)
        columns.append("reasons")
    return out.select(*columns)


def nut_label(allergen: Column, nuts: Column) -> Column:
    """Human label of a pref: 'almonds & pecans', or the allergen itself."""
    names = F.transform(F.filter(text_array(av.NUT_TYPES), lambda n: F.array_contains(nuts, n)), lambda n: lookup(n, av.NUT_LABELS))
    head = F.array_join(F.slice(names, 1, F.greatest(F.size(names) - 1, F.lit(1))), ", ")
    joined = F.when(F.size(names) == 1, F.get(names, F.lit(0))).otherwise(F.concat(head, F.lit(" & "), F.element_at(names, -1)))
    label = F.coalesce(lookup(allergen, {k: v.lower() for k, v in av.ALLERGEN_DISPLAY.items()}), F.replace(allergen, F.lit("_"), F.lit(" ")))
    return F.when(nuts.isNotNull() & (F.size(names) > 0), joined).otherwise(label)


def rationale_text(tier: Column, basis: Column, label: Column, flagged: Column, total: Column, navigable: Column) -> Column:
    """One sentence saying why."""
    return (F.when(navigable, F.format_string("%d of %d dishes involve %s; avoid the flagged dishes and you can likely eat safely.", flagged, total, label))
            .when((tier == "avoid") & basis.isin(sv.GROUNDED_BASES), F.format_string("%s runs across the menu (%d of %d dishes).", F.initcap(label), flagged, total))
            .when(basis == "allergen_matrix", F.format_string("Allergen chart present and does not list %s; cross-contact still possible.", label))
            .when(basis == "menu_coverage", F.format_string("Reviewed %d menu items; none name %s: mild reassurance only.", total, label))
            .when(basis == "suspected_nuts", F.format_string("No dish names %s, but some types often hide it.", label))
            .otherwise(F.format_string("Estimated from cuisine, dish names and location for %s.", label)))


def score(pairs: DataFrame, prefs: DataFrame, restaurants: DataFrame, items: DataFrame, community: DataFrame, as_of_year: int, kb=None,
          baselines: Mapping[str, Mapping[str, float]] = sv.GENERIC_BASELINES, with_rationale: bool = False, with_reasons: bool = False,
          told: Callable[[DataFrame], DataFrame] | None = None, in_order: bool = False) -> DataFrame:
    """Risk of every requested (user, restaurant) pair and pref.

    The ladder reads nothing of a user but the pref: prefs that say the same climb it once per restaurant, however many users have them.
    ``told`` turns these verdicts into other rows of the same restaurant_id and pref_key, before users meet them.
    ``in_order`` lets equal verdicts lie side by side, so that long ones take little room where they are written.
    """
    said = ["class_key", "allergen", "nut_types", "families", "severity", "cross_contact"]
    # A pref travels with the requests as eight bytes.
    keyed = with_class(prefs).withColumn("pref_key", F.xxhash64(F.to_json(F.struct("allergen", "nut_types", "severity", "cross_contact"))))
    # Few rows a user on the side of the prefs: hashed, so that the pairs need no sort.
    # Requests, and what is asked of a restaurant, are found once, however often the steps below read them.
    requests = written(pairs.select("user_id", "restaurant_id").join(keyed.select("user_id", "pref_ord", "pref_key").hint("shuffle_hash"), "user_id"))
    asked = written(requests.select("restaurant_id", "pref_key").distinct().join(written(keyed.select("pref_key", *said).distinct()), "pref_key"))
    needs = asked.select("restaurant_id", "class_key", "allergen", "nut_types", "families").distinct()
    flags = class_flags(items, restaurants, needs, as_of_year, kb, baselines)
    facts = (needs.select("restaurant_id", "class_key", "allergen").join(grown(flags), ["restaurant_id", "class_key"], "left")
             .join(grown(restaurants.select("restaurant_id", "cuisines", "region", *SIGNALS)), "restaurant_id")
             .join(grown(community_rollup(community).select("restaurant_id", "adverse", "n_poor", "best_poor")), "restaurant_id", "left"))
    facts = facts.withColumn("base", _class_base(F.col("cuisines"), F.col("region"), F.col("allergen"), baselines)).drop("cuisines", "allergen")
    verdicts = fuse(asked.join(grown(facts), ["restaurant_id", "class_key"]), ["restaurant_id", "pref_key", "allergen", "class_key", "severity"], with_rationale, with_reasons)
    verdicts = verdicts if told is None else told(verdicts)
    # Few rows a restaurant on the side of the verdicts: hashed, so that the requests need no sort. In order, only they are sorted, before texts meet them.
    scored = requests.join(grown(verdicts) if in_order else verdicts.hint("shuffle_hash"), ["restaurant_id", "pref_key"])
    return scored.select("user_id", "restaurant_id", "pref_ord", *[c for c in verdicts.columns if c not in ("restaurant_id", "pref_key")])


def profile_rollup(assessments: DataFrame, kept: Sequence[str] = ()) -> DataFrame:
    """Worst allergen per user and restaurant sets tier, basis and confidence; ``kept`` columns say the same in all rows of a restaurant."""
    rank = lookup(F.col("tier"), sv.TIER_RANK)
    worst = F.max_by(F.struct("tier", "basis", "confidence", "allergen"), F.struct(rank, "risk", -F.col("pref_ord")))
    return assessments.groupBy("user_id", "restaurant_id").agg(
        worst.alias("w"), F.max("risk").alias("overall_risk"), F.bool_or("community_reported").alias("community_reported"), *[F.max(c).alias(c) for c in kept]).select(
        "user_id", "restaurant_id", "overall_risk", F.col("w.confidence").alias("overall_confidence"), "w.tier", F.col("w.basis").alias("evidence_basis"),
        F.col("w.allergen").alias("worst_allergen"), "community_reported", *kept)


def safest_first(quality: Column) -> list[Column]:
    """Sort keys: tier, risk, certainty, quality."""
    return [lookup(F.col("tier"), sv.TIER_RANK).asc(), F.asc("overall_risk"), F.desc("overall_confidence"), quality.desc(), F.asc("restaurant_id")]


def rank_for_user(rolled: DataFrame, quality: Column, top: int | None = None) -> DataFrame:
    """Restaurants safest-first per user, with their position: all, or each user's first ``top``."""
    return keep_first(rolled, ["user_id"], safest_first(quality), top, rank="position")


# --- After an outside scorer --------------------------------------------------------------
def apply_guardrails(det: DataFrame, model: DataFrame) -> DataFrame:
    """Model scores held inside the band the rules allow.

    ``det`` holds key, tier, risk, confidence, basis, severity,
    community_reported, evidence_ids; ``model`` key, model_tier, model_risk,
    model_confidence, cited_ids. Rows the model skipped keep the rules' score.
    """
    joined = det.join(model, "key", "left")
    rank, model_rank = lookup(F.col("tier"), sv.TIER_RANK), lookup(F.lower(F.trim("model_tier")), sv.TIER_RANK)
    floor = lookup(F.col("severity"), {k: v[2] for k, v in sv.SEVERITY.items()})
    grounded = F.col("basis").isin(sv.GROUNDED_BASES)
    ceiling = F.least(F.lit(cv.MAX_RISK), F.col("risk") + sv.MODEL_UPWARD_BAND)
    raw = F.coalesce("model_risk", "risk")
    held = F.greatest(F.when(grounded, F.col("risk")).otherwise(floor), F.least(ceiling, raw))
    cap = F.when(F.col("community_reported"), rank).otherwise(sv.TIER_RANK["caution"])
    new_rank = F.when(grounded, rank).otherwise(F.least(F.coalesce(model_rank, rank), cap))
    tiers = F.element_at(text_array(list(sv.TIER_RANK)), new_rank + 1)
    scored = F.coalesce("model_risk", "model_confidence").isNotNull() | F.col("model_tier").isNotNull()
    return joined.select(
        "key", F.when(scored, tiers).otherwise(F.col("tier")).alias("tier"), F.when(scored, py_round(held, 3)).otherwise(F.col("risk")).alias("risk"),
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("model_confidence", "confidence"))), 2).alias("confidence"), "basis",
        F.array_intersect(F.coalesce("cited_ids", text_array([])), "evidence_ids").alias("citations"))


def menu_label_scenario(items: DataFrame) -> DataFrame:
    """labeled / raw_menu / no_menu by the share of charted dishes."""
    named = has_value(F.col("item_name"))
    charted = F.count_if(named & F.lower("extraction_method").contains("matrix"))
    return items.groupBy("restaurant_id").agg(F.count_if(named).alias("n_named"), charted.alias("n_charted")).withColumn(
        "scenario", F.when(F.col("n_named") == 0, "no_menu").when(F.col("n_charted") / F.col("n_named") >= sv.LABELED_SHARE, "labeled").otherwise("raw_menu"))


def compact_menu(items: DataFrame, limit: int | None = None) -> DataFrame:
    """All, or the first ``limit``, distinct dish names of a restaurant with their sorted tags."""
    named = items.where(has_value(F.col("item_name"))).withColumn("_key", F.lower(F.trim("item_name")))
    first = keep_first(named, ["restaurant_id", "_key"], [F.asc("arrival")])
    top = keep_first(first, ["restaurant_id"], [F.asc("arrival")], limit, rank="position")
    tags = F.array_join(F.array_sort(F.array_distinct("allergen_terms")), ", ")
    return top.select("restaurant_id", "position", F.when(F.size("allergen_terms") > 0, F.concat(F.trim("item_name"), F.lit(" ["), tags, F.lit("]"))).otherwise(
        F.trim("item_name")).alias("line"))
