"""Diet compatibility of menus and its use as a ranking tiebreak."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dinesight.functions.literals import MAX_LITERAL_ENTRIES, contains_any, let, lookup, text_array
from dinesight.functions.text import has_value
from dinesight.operators.common import bounded_rows, keep_first
from dinesight.operators.tagging import canonical_allergen
from dinesight.vocab import allergens as av
from dinesight.vocab import scoring as sv


def _item_kind(diet: str, terms_by_category: dict[str, list[str]]) -> Column:
    """conflict / labeled / assumed for one dish row."""
    words = sorted({w for c in av.DIET_EXCLUDED_CATEGORIES[diet] for w in terms_by_category.get(c, [])})
    excluded = text_array(av.DIET_EXCLUDED_ALLERGENS[diet])
    by_term = F.arrays_overlap(F.array_compact(F.transform(F.coalesce(F.col("allergen_terms"), text_array([])), canonical_allergen)), excluded)
    by_name = contains_any(F.lower("item_name"), words) if words else F.lit(False)
    label = F.exists(F.coalesce(F.col("dietary_terms"), text_array([])), lambda t: F.lower(t).isin(av.DIET_LABELS[diet]))
    return F.when(by_term | by_name, "conflict").when(label, "labeled").otherwise("assumed")


def judged_items(items: DataFrame, diets: Sequence[str], diet_terms: DataFrame, judgments: DataFrame | None = None) -> DataFrame:
    """Every dish and diet with its kind: conflict, ai (judged fit), labeled or assumed.

    ``diet_terms`` holds category, term (animal-product words, a fixed list of a
    few hundred); ``judgments`` restaurant_id, arrival, diet, verdict.
    """
    rows = bounded_rows(diet_terms, MAX_LITERAL_ENTRIES)
    if rows is None:
        raise ValueError(f"diet terms exceed {MAX_LITERAL_ENTRIES} rows")
    by_category: dict[str, list[str]] = {}
    for row in rows:
        by_category.setdefault(row["category"], []).append(row["term"].lower())
    kinds = F.array(*[F.struct(F.lit(d).alias("diet"), _item_kind(d, by_category).alias("floor")) for d in diets])
    long = items.select("restaurant_id", "arrival", "item_name", F.inline(kinds))
    if judgments is not None:
        long = long.join(judgments.select("restaurant_id", "arrival", "diet", F.col("verdict").alias("_judged")), ["restaurant_id", "arrival", "diet"], "left")
    else:
        long = long.withColumn("_judged", F.lit(None).cast("string"))
    kind = F.when(F.col("_judged") == "no", "conflict").when(F.col("_judged") == "yes", "ai").otherwise(F.col("floor"))
    return long.withColumn("kind", kind).drop("floor", "_judged")


def diet_dishes(judged: DataFrame, limit: int = 10) -> DataFrame:
    """The first offending and compatible dishes of every restaurant and diet: labeled ones before judged and assumed ones."""
    side = F.when(F.col("kind") == "conflict", "offending").otherwise("compatible")
    order = F.when(F.col("kind") == "labeled", 0).when(F.col("kind") == "ai", 1).otherwise(2)
    return keep_first(judged.withColumn("side", side), ["restaurant_id", "diet", "side"], [order, F.asc("arrival")], limit, rank="position").select(
        "restaurant_id", "diet", "side", "position", "item_name")


def assess_diets(judged: DataFrame, accommodations: DataFrame | None = None, restaurants: DataFrame | None = None,
                 diets: Sequence[str] = ()) -> DataFrame:
    """Verdict, basis and support of every restaurant and diet of ``judged_items``.

    Each of ``restaurants`` without a dish is unknown for each of ``diets``.
    """
    counts = judged.groupBy("restaurant_id", "diet").agg(
        F.count("*").alias("total"), *[F.count_if(F.col("kind") == k).alias(k) for k in ("labeled", "assumed", "ai", "conflict")])
    noted = counts.withColumn("accommodated", F.lit(False))
    if accommodations is not None:
        offers = accommodations.where(has_value(F.col("quote"))).select("restaurant_id", "diet").distinct().withColumn("_a", F.lit(True))
        noted = counts.join(offers, ["restaurant_id", "diet"], "left").withColumn("accommodated", F.coalesce("_a", F.lit(False))).drop("_a")
    ok = F.col("labeled") + F.col("assumed") + F.col("ai")
    sure = (F.col("labeled") + F.col("ai")) / F.col("total")
    capped = (F.col("diet") == "vegan") & (F.col("assumed") > 0) & (sure < av.DIET_GOOD_SHARE)
    verdict = (F.when(ok == 0, F.when(F.col("conflict") == F.col("total"), "not_compatible").otherwise("unknown"))
               .when((ok / F.col("total") >= av.DIET_GOOD_SHARE) & ~capped, "good_options").otherwise("limited"))
    basis = (F.when(ok == 0, "none").when((F.col("ai") > 0) & (F.col("labeled") + F.col("assumed") == 0), "ai_assessed")
             .when((F.col("ai") > 0) | ((F.col("labeled") > 0) & (F.col("assumed") > 0)), "mixed").when(F.col("labeled") > 0, "labeled").otherwise("estimated"))
    upgraded = let(verdict, lambda v: F.when(F.col("accommodated") & (v == "limited"), "good_options").when(
        F.col("accommodated") & (v == "unknown"), "limited").otherwise(v))
    rated = noted.withColumns({"verdict": upgraded, "basis": basis, "support": F.when(ok > 0, F.round(ok / F.col("total"), 2)).otherwise(0.0)})
    if restaurants is None:
        return rated
    every = restaurants.select("restaurant_id").distinct().withColumn("diet", F.explode(text_array(diets)))
    return every.join(rated, ["restaurant_id", "diet"], "left").withColumns({
        "verdict": F.coalesce("verdict", F.lit("unknown")), "basis": F.coalesce("basis", F.lit("none")), "support": F.coalesce("support", F.lit(0.0)),
        **{c: F.coalesce(c, F.lit(0)) for c in ("total", "labeled", "assumed", "ai", "conflict")}, "accommodated": F.coalesce("accommodated", F.lit(False))})


def valid_judgments(raw: DataFrame, items: DataFrame, diets: Sequence[str]) -> DataFrame:
    """Judgments of a requested diet, on a real dish, with a known verdict."""
    cleaned = raw.withColumns({"diet": F.lower("diet"), "item_name": F.lower(F.trim("item_name")), "verdict": F.lower("verdict"),
                               "confidence": F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0))})
    real = items.select("restaurant_id", F.lower(F.trim("item_name")).alias("item_name")).distinct()
    return cleaned.where(F.col("diet").isin(list(diets)) & F.col("verdict").isin("yes", "no", "unknown")).join(
        real, ["restaurant_id", "item_name"], "left_semi")


def diet_tiebreak(cards: DataFrame, assessed: DataFrame, diets: Sequence[str], limit: int | None = None) -> DataFrame:
    """Cards by risk; equal risks by the weakest diet fit, best first.

    ``cards`` holds restaurant_id, risk. A card without diet data sorts last;
    a diet missing from a card's data counts as unknown.
    """
    wanted = assessed.where(F.col("diet").isin(list(diets)))
    verdict, basis = lookup(F.col("verdict"), sv.VERDICT_RANK), lookup(F.col("basis"), sv.BASIS_RANK)
    worst = wanted.groupBy("restaurant_id").agg(F.min(verdict).alias("_v"), F.min(basis).alias("_b"), F.countDistinct("diet").alias("_n"))
    missing = F.col("_n") < len(set(diets))
    keyed = cards.join(worst, "restaurant_id", "left").withColumns({
        "_v": F.coalesce(F.when(missing, F.least("_v", F.lit(sv.VERDICT_RANK["unknown"]))).otherwise(F.col("_v")), F.lit(-1)),
        "_b": F.coalesce(F.when(missing, F.lit(0)).otherwise(F.col("_b")), F.lit(-1))})
    order = [F.asc("risk"), F.desc("_v"), F.desc("_b"), F.asc("restaurant_id")]
    if limit is None:
        return keyed.orderBy(*order).drop("_v", "_b", "_n")
    # A bounded top list: partial top-k per partition, then one small sort.
    top = keyed.orderBy(*order).limit(limit)
    return top.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))).drop("_v", "_b", "_n")
