"""Vocabulary tagging: literal terms, implied allergens, dish knowledge."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dinesight.functions.literals import (
    MAX_LITERAL_ENTRIES, contained_rows, contains_any, first_letters, let, letter_tree, matches, text_array)
from dinesight.functions.text import blank_to_empty, norm_ws
from dinesight.operators.common import bounded_rows
from dinesight.vocab import allergens as av
from dinesight.vocab import cuisines as cv
from dinesight.vocab import ingredients as iv

ANCHOR = 3


def mask_words(text: Column, words: Sequence[str]) -> Column:
    """Blank whole words so their inner substrings cannot match."""
    if not words:
        return text
    return F.regexp_replace(text, rf"{first_letters(words)}(?<!\p{{L}})(?:{letter_tree(words)})(?!\p{{L}})", " ")


def matched_terms(text: Column, terms: Sequence[str], false_friends: Mapping[str, Sequence[str]] | None = None) -> Column:
    """Sorted terms that occur in the text, ignoring false-friend words."""
    friends = false_friends or {}
    plain = [t for t in dict.fromkeys(terms) if t not in friends]

    def found(low: Column) -> Column:
        parts = [F.filter(text_array(plain), lambda t: low.contains(t))]
        for term in dict.fromkeys(terms):
            if term in friends:
                hit = low.contains(term) & mask_words(low, friends[term]).contains(term)
                parts.append(F.when(hit, F.array(F.lit(term))).otherwise(text_array([])))
        return F.array_sort(F.concat(*parts))

    return let(F.lower(blank_to_empty(text)), found)


def tag_terms(docs: DataFrame, text: str, terms: Sequence[str] | DataFrame, id_cols: Sequence[str],
              false_friends: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Long table (id, term) of vocabulary terms found in each text.

    A fixed list inlines into the scan as a projection. A vocabulary table
    (column ``term``) of any size joins by substring anchors, see match_table.
    """
    if isinstance(terms, DataFrame):
        if false_friends:
            raise ValueError("false friends apply to fixed term lists")
        return match_table(docs, text, terms, id_cols)
    return docs.select(*id_cols, F.explode(matched_terms(F.col(text), terms, false_friends)).alias("term"))


def match_table(docs: DataFrame, text: str, vocab: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """Substring matches of a vocabulary table of any size.

    Every text is reduced to its distinct three-character pieces; a term joins
    on its first three, so only texts that may hold it are tested. Shorter
    terms are few (bounded by the alphabet) and join on their own length. The
    pieces travel with a hash of the text; the text itself meets its candidate
    terms once, in the join that tests them.
    """
    low = F.lower(blank_to_empty(F.col(text)))
    terms = vocab.select(F.lower("term").alias("term")).where(F.length("term") > 0).distinct().withColumn(
        "_anchor", F.substring("term", 1, ANCHOR))
    grams = F.array_distinct(F.flatten(F.transform(
        F.sequence(F.lit(1), F.greatest(F.length("_low"), F.lit(1))),
        lambda i: F.array(*[F.substr(F.col("_low"), i, F.lit(n)) for n in range(1, ANCHOR + 1)]))))
    texts = docs.select(*id_cols, low.alias("_low")).withColumn("_hash", F.xxhash64("_low"))
    candidates = texts.select("_hash", F.explode(grams).alias("_anchor")).distinct().join(terms, "_anchor").select("_hash", "term").distinct()
    return texts.join(candidates, "_hash").where(F.col("_low").contains(F.col("term"))).select(*id_cols, "term")


def vocab_gap(left: DataFrame, right: DataFrame) -> DataFrame:
    """Terms of the left vocabulary in which no right term occurs."""
    covered = match_table(left.select(F.col("term").alias("_id"), F.col("term").alias("_text")), "_text", right, ["_id"])
    return left.join(covered.select(F.col("_id").alias("term")).distinct(), "term", "left_anti")


# --- Implied allergens ----------------------------------------------------------
def _whole_word(variants: Sequence[str]) -> str:
    return rf"{first_letters(variants)}(?<![a-z])(?:{letter_tree(variants)})s?(?![a-z])"


def _variant_table(rules: Sequence[Mapping]) -> tuple[list[dict], list[str]]:
    """Variant -> rule ids, counting variants that begin inside a longer one.

    One scan finds the longest variant at each word start; a shorter variant of
    another rule at the same place is a whole-word prefix of it.
    """
    variants = list(dict.fromkeys(v for rule in rules for v in rule["variants"]))
    rows = []
    for variant in variants:
        inside = [i for i, rule in enumerate(rules)
                  if any(re.match(rf"{re.escape(v)}s?(?![a-z])", variant) for v in rule["variants"])]
        rows.append({"variant": variant, "rules": inside})
    return rows, variants


def infer_allergens(text: Column, rules: Sequence[Mapping] | None = None,
                    free_from: Sequence[tuple[Sequence[str], Sequence[str]]] | None = None) -> Column:
    """struct(definite, may): allergens implied by ingredient words.

    One pattern finds every ingredient word; only rules whose word occurs and
    that carry exclusions look at the text again.
    """
    rules = iv.ingredient_rules() if rules is None else rules
    free_from = iv.FREE_FROM if free_from is None else free_from
    rows, variants = _variant_table(rules)
    rules_of = F.map_from_arrays(text_array(variants), F.array(*[F.array(*[F.lit(i) for i in row["rules"]]) for row in rows]))
    scan = rf"{first_letters(variants)}(?<![a-z])(?=((?:{letter_tree(variants)}))s?(?![a-z]))"
    free_words = list(dict.fromkeys(p for phrases, _ in free_from for p in phrases))
    none = text_array([])

    def suppressed(norm: Column) -> Column:
        hits = [F.when(matches(norm, _whole_word(phrases)), text_array(tokens)).otherwise(none) for phrases, tokens in free_from]
        return F.when(contains_any(norm, free_words), F.flatten(F.array(*hits))).otherwise(none)

    def fired(norm: Column, hits: Column) -> Column:
        by_word = F.flatten(F.transform(hits, lambda word: F.element_at(rules_of, word)))
        return F.filter(F.array_distinct(by_word), lambda i: allowed(norm, i))

    def allowed(norm: Column, rule_id: Column) -> Column:
        result = F.lit(True)
        for i, rule in enumerate(rules):
            if rule["exclusions"]:
                local = norm
                for phrase in rule["exclusions"]:
                    local = F.replace(local, F.lit(phrase), F.lit("  "))
                result = F.when(rule_id == i, matches(local, _whole_word(rule["variants"]))).otherwise(result)
        return result

    def tokens_of(ids: Column, tier: str) -> Column:
        by_rule = F.array(*[text_array(rule["tokens"] if rule["tier"] == tier else []) for rule in rules])
        return F.array_distinct(F.flatten(F.transform(ids, lambda i: F.element_at(by_rule, i + 1))))

    def split(ids: Column, out: Column) -> Column:
        return let(F.array_except(tokens_of(ids, "def"), out), lambda definite: F.struct(
            F.array_sort(definite).alias("definite"),
            F.array_sort(F.array_except(F.array_except(tokens_of(ids, "may"), out), definite)).alias("may")))

    def infer(norm: Column) -> Column:
        words = F.array_distinct(F.regexp_extract_all(norm, F.lit(scan), F.lit(1)))
        return let(words, lambda hits: F.when(F.size(hits) > 0, let(fired(norm, hits), lambda ids: split(ids, suppressed(norm))))
                   .otherwise(F.struct(none.alias("definite"), none.alias("may"))))

    return let(F.concat(F.lit(" "), F.lower(blank_to_empty(text)), F.lit(" ")), infer)


def enrich_inferred(items: DataFrame) -> DataFrame:
    """Fold implied allergens into dish rows; chart rows stay as parsed."""
    text = F.concat_ws(" ", "item_name", "description", "raw_text")
    marked = items.withColumn("_i", F.when(~F.lower("extraction_method").contains("matrix"), infer_allergens(text)))
    terms = F.array_union("allergen_terms", F.coalesce("_i.definite", text_array([])))
    cross = F.array_union("cross_contact_terms", F.array_except(F.coalesce("_i.may", text_array([])), terms))
    return marked.withColumns({"allergen_terms": terms, "cross_contact_terms": cross}).drop("_i")


def canonical_allergen(term: Column) -> Column:
    """Canonical key of any accepted allergen spelling."""
    from dinesight.functions.literals import lookup
    forms = {form: key for key, names in av.ALLERGEN_FORMS.items() for form in [key.replace("_", " "), *names]}
    return lookup(F.trim(F.lower(F.replace(term, F.lit("_"), F.lit(" ")))), forms)


def chart_token(header: Column) -> Column:
    """Allergen token of a chart column header; coconut is not a nut."""
    probe = F.replace(F.lower(F.trim(blank_to_empty(header))), F.lit("coconut"), F.lit(" "))
    token = None
    for name, forms in av.CHART_HEADERS:
        hit = contains_any(probe, forms)
        token = F.when(hit, name) if token is None else token.when(hit, name)
    return token


def grid_prefilter(text: Column) -> Column:
    """The text could hold an allergen grid: a keyword, or three header words."""
    rows = [{"form": form, "token": token} for token, forms in [("", av.CHART_GRID_WORDS), *av.CHART_HEADERS] for form in forms]
    found = contained_rows(F.lower(blank_to_empty(text)), rows, "form", "form string, token string")
    return let(F.array_distinct(F.transform(found, lambda r: r.token)), lambda tokens: F.array_contains(tokens, "") | (F.size(tokens) >= 3))


# --- Dish knowledge -----------------------------------------------------------------
_DISH_SCHEMA = "pattern string, families array<string>, risk double, note string, nuts array<string>, ord int"
_SUSPECT_SCHEMA = "pattern string, families array<string>, note string, ord int"


def dish_text(name: Column, description: Column) -> Column:
    return norm_ws(F.concat(blank_to_empty(name), F.lit(" "), blank_to_empty(description)))


def dish_hits(text: Column, rules: Sequence[Mapping] | None = None) -> Column:
    """All dish-knowledge entries named in a normalised dish text."""
    friends = [w for words in cv.DISH_FALSE_FRIENDS.values() for w in words]
    return contained_rows(mask_words(text, friends), cv.dish_rules() if rules is None else rules, "pattern", _DISH_SCHEMA)


def suspected_hits(text: Column) -> Column:
    """All suspected dish types of a normalised dish text."""
    return contained_rows(text, cv.suspected_rules(), "pattern", _SUSPECT_SCHEMA)


def best_dish(hits: Column, families: Column, nuts: Column) -> Column:
    """struct(risk, note) of the riskiest wanted entry, first in order on ties.

    ``nuts`` is the user's nut selection, null for the whole family.
    """
    wanted = F.filter(hits, lambda r: F.arrays_overlap(r.families, families) & (
        nuts.isNull() | (F.size(r.nuts) == 0) | F.arrays_overlap(r.nuts, nuts)))
    ranked = F.transform(wanted, lambda r: F.struct(r.risk.alias("risk"), (-r.ord).alias("rank"), r.note.alias("note")))
    return let(F.array_max(ranked), lambda b: F.when(b.isNotNull(), F.struct(b.risk.alias("risk"), b.note.alias("note"))))


def first_suspected(hits: Column, text: Column, families: Column, cuisines: Column) -> Column:
    """Note of the first suspected type; dairy analogues at plant-based kitchens."""
    listed = F.array_min(F.transform(F.filter(hits, lambda r: F.arrays_overlap(r.families, families)),
                                     lambda r: F.struct(r.ord.alias("ord"), r.note.alias("note"))))
    plant = F.coalesce(F.arrays_overlap(cuisines, text_array(["vegan", "vegetarian"])), F.lit(False)) & F.array_contains(families, "tree_nuts")
    dairy = let(text, lambda t: F.get(F.filter(text_array(cv.VEGAN_SUSPECTED), lambda p: t.contains(p)), F.lit(0)))
    analogue = F.when(plant, F.concat(F.lit("plant-based '"), dairy, F.lit("' is usually cashew-based")))
    return F.coalesce(listed.note, analogue)


def item_prior(items: DataFrame, families: Column, nuts: Column, cuisines: Column, region: Column) -> DataFrame:
    """Nut prior of every dish: claim, dish knowledge, suspected type, cuisine.

    Adds prior_risk, prior_confidence, prior_basis, prior_note.
    """
    from dinesight.operators.entities import boost_at_home, cuisine_prior
    text = dish_text(F.col("item_name"), F.col("description"))
    marked = items.withColumn("_text", text).withColumn("_base", cuisine_prior(cuisines, region)).withColumn(
        "_dish", best_dish(dish_hits(F.col("_text")), families, nuts)).withColumn(
        "_suspect", first_suspected(suspected_hits(F.col("_text")), F.col("_text"), families, cuisines))
    claim = contains_any(F.col("_text"), av.NUT_FREE_CLAIMS)
    dish_risk = F.least(F.lit(cv.MAX_RISK), boost_at_home(F.col("_dish.risk"), cuisines, region, 0.10))
    named, suspect = F.col("_dish").isNotNull(), F.col("_suspect").isNotNull()
    return marked.withColumns({
        "prior_risk": F.when(claim, 0.08).when(named, dish_risk).when(
            suspect, F.greatest(F.col("_base.risk"), F.lit(cv.SUSPECTED_RISK))).otherwise(F.col("_base.risk")),
        "prior_confidence": F.when(claim, 0.6).when(named, 0.8).when(suspect, cv.SUSPECTED_CONFIDENCE).otherwise(F.col("_base.confidence")),
        "prior_basis": F.when(claim, "nut_free_claim").when(named, "dish_knowledge").when(suspect, "suspected_nuts").otherwise(F.col("_base.basis")),
        "prior_note": F.when(claim, "menu text states a nut-free claim").when(named, F.col("_dish.note")).otherwise(F.col("_suspect")),
    }).drop("_text", "_base", "_dish", "_suspect")


def generic_dish_prior(items: DataFrame, kb: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """Per item and allergen the riskiest knowledge-base entry.

    ``kb`` holds allergen, pattern, risk, note, ord. A small base inlines into
    the scan; a larger one joins by substring anchors.
    """
    text = dish_text(F.col("item_name"), F.col("description"))
    rows = bounded_rows(kb, MAX_LITERAL_ENTRIES)
    if rows is not None:
        schema = "allergen string, pattern string, risk double, note string, ord int"
        hits = contained_rows(text, rows, "pattern", schema)
        long = items.select(*id_cols, F.inline(hits))
    else:
        found = match_table(items.select(*id_cols, text.alias("_text")), "_text", kb.select(F.col("pattern").alias("term")), id_cols)
        long = found.withColumnRenamed("term", "pattern").join(kb, "pattern")
    best = F.max_by(F.struct("risk", "note"), F.struct("risk", -F.col("ord")))
    return long.where("risk > 0").groupBy(*id_cols, "allergen").agg(best.alias("b")).select(*id_cols, "allergen", "b.risk", "b.note")
