"""Grounding, merging and rolling up menu evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dinesight.functions.literals import contains_any, quoted_pattern, text_array
from dinesight.functions.text import blank_to_empty, has_value, norm_key, norm_ws, strip_size_suffix, strip_ws, words
from dinesight.operators.common import keep_first, merge_records, union_terms
from dinesight.operators.tagging import chart_token
from dinesight.vocab import allergens as av

TERM_ARRAYS = ("allergen_terms", "cross_contact_terms", "dietary_terms", "matrix_allergen_columns")


# --- Grounding --------------------------------------------------------------------
def _bounded(needle: Column, hay: Column) -> Column:
    """The needle occurs with no word character on either side."""
    pattern = F.concat(F.lit(r"(?U)(?<!\w)"), quoted_pattern(needle), F.lit(r"(?!\w)"))
    return (F.length(needle) > 0) & hay.contains(needle) & F.regexp_like(hay, pattern)


def _traceable(name: Column, collapsed: Column) -> Column:
    stripped = strip_ws(name)
    return _bounded(norm_ws(name), collapsed) | (
        (F.length(stripped) >= 8) & F.replace(collapsed, F.lit(" "), F.lit("")).contains(stripped))


def quote_supports_name(name: Column, quote: Column) -> Column:
    """Most significant words of the name occur in the quote."""
    tokens = words(strip_size_suffix(name), 4)
    hits = F.size(F.filter(tokens, lambda t: F.lower(quote).contains(t)))
    return (F.size(tokens) > 0) & (hits >= F.floor((F.size(tokens) + 1) / 2))


def ground_names(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Marks each row kept or dropped by tracing it to its source text.

    ``items`` holds source_url, item_name, quote; ``sources`` source_url, text.
    Texts are normalised once per source, before the join.
    """
    texts = sources.select("source_url", norm_ws(F.col("text")).alias("_text"))
    joined = items.join(texts, "source_url", "left")
    name, quote, text = F.col("item_name"), F.col("quote"), F.col("_text")
    base = strip_size_suffix(name)
    grounded = (_traceable(name, text) | ((base != name) & (F.length(base) > 0) & _traceable(base, text))
                | (has_value(quote) & quote_supports_name(name, quote) & _traceable(quote, text)))
    kept = F.when(~has_value(text), True).otherwise(F.coalesce(grounded, F.lit(False)))
    return joined.withColumn("kept", kept).withColumn(
        "reason", F.when(~F.col("kept"), "neither item name nor evidence quote traceable to source text")).drop("_text")


def _straight(c: Column) -> Column:
    return F.translate(F.lower(blank_to_empty(c)), "“”‘’", "\"\"''")


def quote_grounded(quote: Column, stripped_source: Column) -> Column:
    """Any substantial ellipsis-separated fragment of the quote is in the source."""
    def inside(needle: Column) -> Column:
        return (F.length(needle) > 0) & (stripped_source.contains(needle) | (
            (F.length(needle) > 40) & stripped_source.contains(F.substring(needle, 1, 40))))

    parts = F.transform(F.split(blank_to_empty(quote), r"\.\.\.|…"), lambda p: strip_ws(_straight(p)))
    substantial = F.filter(parts, lambda p: F.length(p) >= 8)
    return F.when(F.size(substantial) > 0, F.exists(substantial, inside)).otherwise(inside(strip_ws(_straight(quote))))


def ground_quotes(records: DataFrame, sources: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Marks records kept when their name or quote is in the source text.

    ``records`` holds the keys, kind ('item' or 'note'), item_name and quote.
    """
    texts = sources.select(*keys, norm_ws(_straight(F.col("text"))).alias("_text"))
    joined = records.join(texts, list(keys), "left")
    text = F.col("_text")
    stripped = F.replace(text, F.lit(" "), F.lit(""))
    name = _straight(F.col("item_name"))
    named = (F.col("kind") == "item") & (((F.length(norm_ws(name)) >= 3) & _bounded(norm_ws(name), text))
                                         | ((F.length(strip_ws(name)) >= 8) & stripped.contains(strip_ws(name))))
    kept = F.when(~has_value(text), True).otherwise(F.coalesce(named | quote_grounded(F.col("quote"), stripped), F.lit(False)))
    return joined.withColumn("kept", kept).drop("_text")


def grounding_warnings(marked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Dropped item and note counts per source."""
    return marked.groupBy(*keys).agg(
        F.count_if(~F.col("kept") & (F.col("kind") == "item")).alias("dropped_items"),
        F.count_if(~F.col("kept") & (F.col("kind") == "note")).alias("dropped_notes"))


def ground_statements(signals: DataFrame, pages: DataFrame, limit: int = 5) -> DataFrame:
    """Keeps quotes found in the page; a nut-free claim must be earned by one."""
    texts = pages.select("url", strip_ws(F.col("text")).alias("_text"))
    joined = signals.join(texts, "url")
    quotes = F.transform("statements", lambda s: F.trim(s))
    kept = F.slice(F.filter(quotes, lambda s: (F.length(s) > 0) & ~s.endswith("?") & F.col("_text").contains(strip_ws(s))), 1, limit)
    marked = joined.withColumn("statements", kept)
    earned = F.exists("statements", lambda s: contains_any(norm_key(s), av.NUT_FREE_FACILITY_KEYS) & ~F.lower(s).contains("option"))
    return marked.withColumn("nut_free_claim", F.col("nut_free_claim") & earned).drop("_text")


# --- Merging ------------------------------------------------------------------------
def structured_rank() -> list[Column]:
    """Order in which rows of one dish win: allergen data, schema, confidence, price."""
    return [F.desc((F.size("allergen_terms") > 0).cast("int")),
            F.desc((~F.col("extraction_method").startswith("gemini")).cast("int")),
            F.desc("confidence"), F.desc(has_value(F.col("price")).cast("int"))]


def dedupe_items_across_sources(items: DataFrame, keys: Sequence[str] = ("restaurant_id",), arrays=TERM_ARRAYS) -> DataFrame:
    """One row per dish: best row's identity, union of all evidence."""
    keyed = items.withColumn("dish_key", norm_ws(F.col("item_name"))).where(F.length("dish_key") > 0)
    return merge_records(keyed, [*keys, "dish_key"], [*structured_rank(), F.asc("arrival")], arrays)


def fold_by_name(items: DataFrame, keys: Sequence[str] = ("restaurant_id",), arrays=TERM_ARRAYS) -> DataFrame:
    """First row's identity per lower-case name, union of all evidence."""
    keyed = items.withColumn("dish_key", F.lower("item_name")).where(F.length("dish_key") > 0)
    return merge_records(keyed, [*keys, "dish_key"], [F.asc("arrival")], arrays)


def dedupe_items_csv(items: DataFrame) -> DataFrame:
    """First row per restaurant, dish words and numeric price."""
    from dinesight.functions.text import dedupe_price, dedupe_text
    keyed = items.withColumn("name_key", dedupe_text(F.col("item_name"))).withColumn("price_key", dedupe_price(F.col("price")))
    return keep_first(keyed, ["restaurant_id", "name_key", "price_key"], [F.asc("arrival")])


def merge_chunks(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """Dishes of one source's chunks merged; incomplete when any chunk failed."""
    merged = fold_by_name(items, keys=("source_url",))
    status = chunks.groupBy("source_url").agg(F.bool_or("failed").alias("incomplete"))
    return merged.join(status, "source_url", "left").withColumn("incomplete", F.coalesce("incomplete", F.lit(False)))


def union_evidence(primary: DataFrame, secondary: DataFrame, keys: Sequence[str] = ("restaurant_id",), key=norm_ws,
                   arrays=TERM_ARRAYS) -> DataFrame:
    """All primary rows, secondary evidence folded into the first match, new keys appended."""
    join_keys = [*keys, "dish_key"]
    first, second = (df.withColumn("dish_key", key(F.col("item_name"))) for df in (primary, secondary))
    named = F.length("dish_key") > 0
    heads = keep_first(first.where(named), join_keys, [F.asc("arrival")]).select(*join_keys, "arrival", F.lit(True).alias("_head"))
    others = merge_records(second.where(named), join_keys, [F.asc("arrival")], arrays)
    extra = others.select(*join_keys, *[F.col(a).alias(f"_{a}") for a in arrays])
    folded = first.join(heads, [*join_keys, "arrival"], "left").join(extra, join_keys, "left")
    merged = folded.select(*[c for c in first.columns if c not in arrays], *[
        F.array_sort(F.when(F.col("_head") & F.col(f"_{a}").isNotNull(), F.array_union(a, f"_{a}")).otherwise(F.col(a))).alias(a) for a in arrays])
    appended = others.join(first.select(*join_keys).distinct(), join_keys, "left_anti")
    return merged.unionByName(appended.select(*merged.columns))


def collapse_components(items: DataFrame, keys: Sequence[str] = ("restaurant_id",),
                        arrays=("allergen_terms", "cross_contact_terms", "matrix_allergen_columns")) -> DataFrame:
    """Component rows folded into every dish of their parent's name.

    Components are unioned per parent key first, so a parent row meets one
    component row however many there are. Orphan components stay as rows.
    """
    parents = items.where(~F.col("is_component")).withColumn("dish_key", norm_key(F.col("item_name")))
    parts = items.where("is_component").withColumn("dish_key", norm_key(F.col("parent_item")))
    join_keys = [*keys, "dish_key"]
    terms = union_terms(parts.where(F.length("dish_key") > 0), join_keys, arrays).select(
        *join_keys, *[F.col(a).alias(f"_{a}") for a in arrays])
    folded = parents.join(terms, join_keys, "left").select(*[c for c in parents.columns if c not in arrays], *[
        F.array_sort(F.array_union(a, F.coalesce(f"_{a}", text_array([])))).alias(a) for a in arrays])
    known = parents.where(F.length("dish_key") > 0).select(*join_keys).distinct()
    orphans = parts.join(known, join_keys, "left_anti")
    return folded.unionByName(orphans.select(*folded.columns)).drop("dish_key")


def net_new_gate(chart: DataFrame, text: DataFrame, source: str = "source_url", factor: float = 1.0) -> DataFrame:
    """Chart rows, plus a source's text rows only when they add enough new dishes."""
    left, right = (df.withColumn("dish_key", norm_key(F.col("item_name"))) for df in (chart, text))
    sizes = left.groupBy(source).agg(F.count("*").alias("_chart"))
    new = right.join(left.select(source, "dish_key").distinct(), [source, "dish_key"], "left_anti").groupBy(source).agg(F.count("*").alias("_new"))
    passing = sizes.join(new, source, "left").where(F.coalesce("_new", F.lit(0)) > F.col("_chart") * factor).select(source)
    uncharted = right.select(source).distinct().join(sizes, source, "left_anti")
    kept = right.join(passing.unionByName(uncharted), source, "left_semi")
    return left.withColumn("origin", F.lit("chart")).unionByName(kept.withColumn("origin", F.lit("text")), allowMissingColumns=True).drop("dish_key")


def interpret_by_precedence(rows: DataFrame, policy: str = "hybrid") -> DataFrame:
    """Per source the rows of the first parser that found any.

    ``rows`` holds source_url, parser and parser_rank (structured parsers
    first); policy 'llm_first' prefers the text reader, 'merge' keeps both.
    """
    is_text = F.col("parser") == "llm_text"
    if policy == "merge":
        return rows
    rank = F.when(is_text, 1000 if policy == "hybrid" else -1).otherwise(F.col("parser_rank"))
    ranked = rows.withColumn("_rank", rank)
    best = ranked.groupBy("source_url").agg(F.min("_rank").alias("_rank"))
    return ranked.join(best, ["source_url", "_rank"], "left_semi").drop("_rank")


def absorb_matrix_rows(rows: DataFrame, max_confidence: float = 0.6) -> DataFrame:
    """Transcribed chart rows -> dish rows; first row of a dish wins.

    ``rows`` holds source_url, row_ord, dish, allergens, cross_contact,
    columns, is_component, of_dish.
    """
    def trimmed(name: str) -> Column:
        return F.filter(F.transform(F.coalesce(F.col(name), text_array([])), lambda t: F.trim(t)), lambda t: F.length(t) > 0)

    dish = F.trim("dish")
    keyed = rows.withColumn("_key", F.lower(dish)).where(F.length("_key") > 0)
    first = keep_first(keyed, ["source_url", "_key"], [F.asc("row_ord")])
    columns = F.array_sort(F.array_distinct(F.array_compact(F.transform(F.coalesce(F.col("columns"), text_array([])), chart_token))))
    terms = trimmed("allergens")
    return first.select(
        "source_url", "row_ord", dish.alias("item_name"), terms.alias("allergen_terms"), trimmed("cross_contact").alias("cross_contact_terms"),
        columns.alias("matrix_allergen_columns"), F.lit("gemini_allergen_matrix").alias("extraction_method"),
        F.lit(max_confidence).alias("confidence"), "is_component",
        F.when(F.col("is_component"), F.trim(blank_to_empty(F.col("of_dish")))).otherwise("").alias("parent_item"),
        F.when(F.size(terms) > 0, F.concat(dish, F.lit(" contains "), F.array_join(terms, ", "))).otherwise(dish).alias("raw_text"))


def flatten_evidence(nested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nested extraction documents -> (items, notes), lists joined by '; '."""
    def joined(struct: str, names: Sequence[str], lists: Sequence[str]) -> list[Column]:
        return [F.array_join(F.col(f"{struct}.{n}"), "; ").alias(n) if n in lists else F.col(f"{struct}.{n}") for n in names]

    item_fields = ("candidate_id is_menu_item category item_name description price currency dietary_tags allergen_mentions "
                   "modification_options evidence_quote source_url source_type extraction_method rule_parser_confidence raw_text "
                   "cleanup_notes confidence").split()
    note_fields = "note_type note_text applies_to evidence_quote source_url confidence".split()
    items = nested.select("restaurant_name", F.explode("menu_items").alias("i")).select(
        "restaurant_name", *joined("i", item_fields, ("dietary_tags", "allergen_mentions", "modification_options")))
    notes = nested.select("restaurant_name", F.explode("restaurant_notes").alias("n")).select(
        "restaurant_name", *joined("n", note_fields, ("applies_to",)))
    return items, notes


# --- Community ------------------------------------------------------------------------
def community_allergen(raw: Column) -> Column:
    """Canonical allergen of a review mention."""
    low = F.lower(blank_to_empty(raw))
    return (F.when(F.length(low) == 0, F.lit(None)).when(low.contains("peanut") | low.contains("groundnut"), "peanuts")
            .when(contains_any(low, ["tree nut", "almond", "cashew", "walnut", "pecan", "hazelnut", "pistachio", "macadamia", "pine nut"]), "tree_nuts")
            .when(low.contains("nut"), "nuts").otherwise(low))


def community_signals(parsed: DataFrame, snippets: DataFrame) -> DataFrame:
    """Typed handling quotes that occur in the snippets they came from.

    ``parsed`` holds restaurant_id, type, allergen, quote; ``snippets``
    restaurant_id, bundle.
    """
    texts = snippets.select("restaurant_id", norm_ws(F.col("bundle")).alias("_text"))
    kind = F.lower(F.trim("type"))
    quote = F.trim("quote")
    joined = parsed.join(texts, "restaurant_id").where(
        ~kind.isin("", "none") & (F.length(quote) > 0) & F.col("_text").contains(norm_ws(quote)))
    return joined.drop("_text").withColumns({"type": kind, "allergen": community_allergen(F.col("allergen")), "quote": F.substring(quote, 1, 240)})


def community_quotes(signals: DataFrame) -> DataFrame:
    """The grounded quotes of ``community_signals`` that are worth showing: reactions, presence and good handling."""
    return signals.where(F.col("type").isin("adverse_event", "allergen_presence", "good_handling")).select("restaurant_id", "quote")


def community_diets(parsed: DataFrame, snippets: DataFrame) -> DataFrame:
    """Vegetarian and vegan quotes that occur in the snippets they came from, with the snippets' first address.

    ``parsed`` holds restaurant_id, diet, quote; ``snippets`` restaurant_id, bundle, url. The text of a bundle is normalised once,
    whatever the number of quotes; quotes of one place and diet that say the same stay apart, as they came.
    """
    texts = snippets.select("restaurant_id", norm_ws(F.col("bundle")).alias("_text"), blank_to_empty(F.col("url")).alias("url"))
    diet, quote = F.lower(F.trim(blank_to_empty(F.col("diet")))), F.trim(blank_to_empty(F.col("quote")))
    wanted = parsed.withColumns({"diet": diet, "quote": quote}).where(F.col("diet").isin("vegetarian", "vegan") & (F.length("quote") > 0))
    grounded = wanted.join(texts, "restaurant_id").where(F.col("_text").contains(norm_ws(F.col("quote")))).drop("_text")
    return grounded.withColumns({"quote": F.substring("quote", 1, 240), "source": F.lit("community")})


def community_dishes(mentions: DataFrame) -> DataFrame:
    """Review-mentioned dishes: distinct names up to 80 characters, low confidence."""
    name = F.trim("dish")
    usable = mentions.where((F.length(name) > 0) & (F.length(name) <= 80)).withColumn("_key", F.lower(name))
    return keep_first(usable, ["restaurant_id", "_key"], [F.asc("mention_ord")]).select(
        "restaurant_id", name.alias("item_name"), F.lit("community").alias("source_type"),
        F.lit("community_mention").alias("extraction_method"), F.lit(0.3).alias("confidence"))


def non_community_items(items: DataFrame) -> DataFrame:
    """Dishes read from a menu, not from reviews."""
    return items.where("source_type <> 'community'")


# --- Signals ---------------------------------------------------------------------------
def handling_flags(text: Column) -> Column:
    """struct of four handling phrases in evidence text, hyphens as spaces."""
    from dinesight.vocab import web
    low = F.replace(F.lower(blank_to_empty(text)), F.lit("-"), F.lit(" "))
    return F.struct(contains_any(low, web.DISCLAIMER_WORDS).alias("has_allergy_disclaimer"),
                    contains_any(low, web.CROSS_CONTACT_WORDS).alias("has_cross_contact_warning"),
                    contains_any(low, web.STAFF_WORDS).alias("mentions_staff_allergy_instruction"),
                    contains_any(low, web.NUT_FREE_WORDS).alias("has_nut_free_claim"))


HANDLING = ("has_allergy_disclaimer", "has_cross_contact_warning", "mentions_staff_allergy_instruction", "has_nut_free_claim")


def restaurant_signals(texts: DataFrame, items: DataFrame) -> DataFrame:
    """Handling phrases anywhere in a restaurant's texts or dish rows."""
    parts = [texts.select("restaurant_id", handling_flags(F.concat_ws(
        " ", "extracted_text", F.array_join("dietary_terms", " "), F.array_join("allergen_terms", " "))).alias("f"))]
    parts.append(items.select("restaurant_id", handling_flags(F.concat_ws(
        " ", "item_name", "description", "raw_text", "price", F.array_join("dietary_terms", " "), F.array_join("allergen_terms", " "))).alias("f")))
    return parts[0].unionByName(parts[1]).groupBy("restaurant_id").agg(*[F.bool_or(f"f.{name}").alias(name) for name in HANDLING])


def signals_rollup(page_signals: DataFrame) -> DataFrame:
    """Page flags -> the five restaurant signals; 'friendly' is a handling signal only."""
    flags = {"nut_free_claim": "nut_free_claim", "cross_contact_warning": "cross_contact_warning", "ask_staff": "ask_staff",
             "allergen_menu_available": "allergen_menu_available", "allergy_disclaimer": "allergy_friendly_claim"}
    return page_signals.groupBy("restaurant_id").agg(*[F.coalesce(F.bool_or(src), F.lit(False)).alias(out) for out, src in flags.items()])


def signal_dedupe(signals: DataFrame, flags: Sequence[str], ordinal: str) -> DataFrame:
    """First signal per flag set and sorted statements."""
    keyed = signals.withColumn("_statements", F.array_join(F.array_sort("statements"), "\u0001"))
    return keep_first(keyed, ["restaurant_id", *flags, "_statements"], [F.asc(ordinal)]).drop("_statements")


def merge_restaurant_signals(rows: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Chunk results per restaurant: OR of flags, best confidence."""
    return rows.groupBy("restaurant_id").agg(*[F.coalesce(F.bool_or(f), F.lit(False)).alias(f) for f in flags],
                                             F.coalesce(F.max("evidence_confidence"), F.lit(0.0)).alias("evidence_confidence"))


def merge_notes(notes: DataFrame) -> DataFrame:
    """Last note per restaurant, type, text and source."""
    return keep_first(notes, ["restaurant_id", "note_type", "note_text", "source_url"], [F.desc("note_ord")])


def source_report(payloads: DataFrame, items: DataFrame) -> DataFrame:
    """Per source: found, items, mean confidence, interpreter; empty sources kept."""
    found = items.groupBy("source_url").agg(F.count("*").alias("_n"), F.round(F.avg("confidence"), 3).alias("_c"),
                                            F.min("parser").alias("_parser"))
    joined = payloads.join(found, "source_url", "left")
    n = F.coalesce("_n", F.lit(0))
    return joined.select("source_url", (n > 0).alias("found"), n.alias("item_count"), F.coalesce("_c", F.lit(0.0)).alias("confidence"),
                         F.coalesce("_parser", F.lit("none")).alias("interpreter"),
                         F.when(n > 0, F.concat(n.cast("string"), F.lit(" items via "), F.col("_parser"))).otherwise("no items found").alias("reason"))


def group_sources(rows: DataFrame) -> DataFrame:
    """Restaurant groups of text rows, as a long table with group size and order."""
    named = rows.where(has_value(F.col("restaurant_name")))
    return named.groupBy("restaurant_source_id", "restaurant_name").agg(
        F.count("*").alias("n_rows"), F.min("row_ord").alias("first_row"), F.sum(F.length("extracted_text")).alias("n_chars"))


def candidate_ids(items: DataFrame, max_candidates: int | None = None) -> DataFrame:
    """c0001, c0002, ... over the rows of every restaurant, or the first ``max_candidates``."""
    ranked = keep_first(items, ["restaurant_id"], [F.asc("arrival")], max_candidates, rank="_n")
    return ranked.withColumn("candidate_id", F.format_string("c%04d", F.col("_n"))).drop("_n")


def candidate_validation_summary(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Per restaurant: candidates, validated, accepted, rejected, missing."""
    joined = candidates.join(verdicts, ["restaurant_id", "candidate_id"], "left")
    return joined.groupBy("restaurant_id").agg(
        F.count("*").alias("candidate_rows"), F.count_if(F.col("is_menu_item").isNotNull()).alias("validated_rows"),
        F.count_if(F.col("is_menu_item")).alias("accepted_rows"), F.count_if(~F.col("is_menu_item")).alias("rejected_rows"),
        F.count_if(F.col("is_menu_item").isNull()).alias("missing_rows"))
