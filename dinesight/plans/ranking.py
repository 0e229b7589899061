"""Flagship plan: rank every user's requested restaurants, safest first."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dinesight.catalog.tables import dishes, pick, places, table
from dinesight.functions.literals import text_array
from dinesight.functions.text import quality_score
from dinesight.functions.urls import host
from dinesight.operators import risk
from dinesight.operators.common import grown
from dinesight.operators.entities import QUALITY_KINDS, cuisines_for

AS_OF_YEAR = 2026
REGIONS = ["US", "TH", "MX", "unknown"]
SEVERITIES = ["anaphylaxis", "allergy", "intolerance", "avoid_preference"]
REVIEW_KINDS = ["adverse_event", "good_handling", "none", "poor_handling", "allergen_presence"]
REVIEW_ALLERGENS = ["peanuts", "", "nuts", "sesame", "milk"]


def restaurants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as restaurants: cuisines, region, handling signals, quality."""
    k = F.col("k")
    signals = {name: k % n == 0 for name, n in (("nut_free_claim", 9), ("cross_contact_warning", 7), ("ask_staff", 5),
                                                ("allergen_menu_available", 11), ("allergy_disclaimer", 6))}
    rows = places(spark, sf_dir).where("source_name = 'openstreetmap'")
    return rows.select("restaurant_id", "k", cuisines_for(F.col("categories"), F.col("name")).alias("cuisines"), pick(REGIONS, k).alias("region"),
                       host(F.col("website_url")).alias("official_domain"), quality_score(QUALITY_KINDS).alias("quality"),
                       *[c.alias(name) for name, c in signals.items()])


def user_prefs(spark: SparkSession, sf_dir: str, allergen: str | None = None) -> DataFrame:
    """Customers as users: nuts for all, some narrowed; milk for every third."""
    key = F.col("c_custkey")
    cross = F.when(key % 4 == 2, "not_concerned").when(key % 4 == 3, "strict")
    narrowed = F.when(key % 5 == 1, text_array(["almond", "pine_nut"]))

    def pref(order: int, name: str, nuts: Column) -> Column:
        return F.struct(F.lit(order).alias("pref_ord"), F.lit(name).alias("allergen"), pick(SEVERITIES, key + order).alias("severity"),
                        cross.alias("cross_contact"), nuts.alias("nut_types"))

    none = F.lit(None).cast("array<string>")
    both = F.array_compact(F.array(pref(0, "nuts", narrowed if allergen is None else none), F.when(key % 3 == 0, pref(1, "milk", none))))
    rows = table(spark, sf_dir, "customer").select(key.alias("user_id"), F.explode(both).alias("p")).select("user_id", "p.*")
    return rows if allergen is None else rows.where(F.col("allergen") == allergen)


def requested_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and the restaurants they bought from."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    joined = lines.join(grown(orders), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(F.col("o_custkey").alias("user_id"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("restaurant_id")).distinct()


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as classified community reports."""
    n = F.col("conv_id") * 3 + F.col("turn")
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("s"), (F.col("conv_id") % 100).cast("string")).alias("restaurant_id"), pick(REVIEW_KINDS, n).alias("type"),
        pick(REVIEW_ALLERGENS, n * 2).alias("allergen"), F.col("text").alias("quote"), (n * 50 % 1000).alias("age_days"))


def assessed(spark: SparkSession, sf_dir: str, allergen: str | None = None, kb=None, with_rationale: bool = False, with_reasons: bool = False,
             told=None, in_order: bool = False) -> DataFrame:
    return risk.score(requested_pairs(spark, sf_dir), user_prefs(spark, sf_dir, allergen), restaurants(spark, sf_dir), dishes(spark, sf_dir),
                      reviews(spark, sf_dir), AS_OF_YEAR, kb=kb, with_rationale=with_rationale, with_reasons=with_reasons, told=told, in_order=in_order)


def rated(spark: SparkSession, sf_dir: str) -> Callable[[DataFrame], DataFrame]:
    """Adds ``qualities`` to verdicts: what each row of their restaurant says, before users meet them."""
    said = restaurants(spark, sf_dir).groupBy("restaurant_id").agg(F.array_sort(F.collect_list(F.struct("quality"))).alias("qualities"))
    return lambda verdicts: verdicts.join(grown(said), "restaurant_id")


def rolled_with_quality(assessments: DataFrame) -> DataFrame:
    """The roll-up of ``rated`` assessments, once per row of the restaurant."""
    rolled = risk.profile_rollup(assessments, ["qualities"])
    return rolled.select("restaurant_id", *[c for c in rolled.columns if c not in ("restaurant_id", "qualities")], F.explode("qualities.quality").alias("quality"))


def ranked_restaurants(spark: SparkSession, sf_dir: str, top: int | None = None) -> DataFrame:
    """Each user's restaurants in safest-first order."""
    from dinesight.catalog.tagging_queries import KB_ROWS
    kb = [dict(zip(("allergen", "pattern", "risk", "note", "ord"), row)) for row in KB_ROWS]
    return risk.rank_for_user(rolled_with_quality(assessed(spark, sf_dir, kb=kb, told=rated(spark, sf_dir))), F.col("quality"), top)
