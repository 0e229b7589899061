"""Safety, calibration, extraction and regression evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dinesight.functions.text import looks_noise, norm_ws, price_ok
from dinesight.operators.common import carry_forward, global_rank_bounds, keep_first


def safety_eval(assessed: DataFrame) -> DataFrame:
    """False-negative and over-warning rates, overall and by cuisine.

    ``assessed`` holds cuisine, truth ('pos'/'neg'), tier, grounded.
    """
    miss = (F.col("truth") == "pos") & (F.col("tier") == "likely_ok")
    over = (F.col("truth") == "neg") & (F.col("tier") == "avoid")
    return assessed.rollup("cuisine").agg(
        F.count_if(F.col("truth") == "pos").alias("n_pos"), F.count_if(miss).alias("n_missed"), F.count_if(F.col("truth") == "neg").alias("n_neg"),
        F.count_if(over).alias("n_overwarned"), F.count_if((F.col("truth") == "pos") & F.col("grounded")).alias("n_grounded_pos"),
        F.count_if(miss & F.col("grounded")).alias("n_grounded_missed")).withColumn("cuisine", F.coalesce("cuisine", F.lit("TOTAL")))


def calibrate_baselines(labeled: DataFrame) -> DataFrame:
    """Smoothed prevalence per cuisine against its current baseline.

    ``labeled`` holds cuisine, truth, baseline.
    """
    counts = labeled.groupBy("cuisine").agg(F.count_if(F.col("truth") == "pos").alias("pos"), F.count("*").alias("n"), F.max("baseline").alias("current"))
    empirical = (F.col("pos") + 0.5) / (F.col("n") + 1.0)
    delta = empirical - F.col("current")
    flag = F.when(F.col("n") < 3, "low-n").when(delta >= 0.20, "REVISIT").when(delta <= -0.20, "revisit").otherwise("")
    return counts.select("cuisine", "pos", "n", empirical.alias("empirical"), "current", delta.alias("delta"), flag.alias("flag"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Tie-aware rank correlation: Pearson correlation of average ranks.

    Ranks come from per-value counts and range offsets, never one global window.
    """
    def ranks(column: str, name: str) -> DataFrame:
        bounds = global_rank_bounds(df, column)
        return bounds.select(column, (F.col("below") + (F.col("peers") + 1) / 2.0).alias(name))

    ranked = df.select(x, y).dropna().join(ranks(x, "_rx"), x).join(ranks(y, "_ry"), y)
    return ranked.agg(F.corr("_rx", "_ry").alias("rho"), F.count("*").alias("n"))


def tier_matrix(assessed: DataFrame, tiers: Sequence[str] = ("avoid", "caution", "likely_ok")) -> DataFrame:
    """Allergen by tier counts."""
    return assessed.groupBy("allergen").pivot("tier", list(tiers)).count().na.fill(0)


def verdict_matrix(assessed: DataFrame, verdicts: Sequence[str] = ("good_options", "limited", "not_compatible", "unknown")) -> DataFrame:
    """Diet by verdict counts."""
    return assessed.groupBy("diet").pivot("verdict", list(verdicts)).count().na.fill(0)


def chain_scorecard(runs: DataFrame) -> DataFrame:
    """Per region and overall: chains, producers, items, allergen items, medians."""
    region = F.when(F.col("home_country") == "US", "US").when(F.col("home_country") == "CA", "Canada").when(
        F.col("home_country").isin("GB", "DE"), "UK + DE").otherwise("Asia-Oceania")
    return runs.withColumn("region", region).rollup("region").agg(
        F.count("*").alias("n_chains"), F.count_if(F.col("item_count") > 0).alias("n_with_menu"), F.count_if(F.col("allergen_item_count") > 0).alias("n_with_allergens"),
        F.sum("item_count").alias("n_items"), F.sum("allergen_item_count").alias("n_allergen_items"),
        F.percentile("item_count", F.lit(0.5)).alias("median_items"), F.round(F.avg("elapsed_s"), 1).alias("mean_seconds")).withColumn(
        "region", F.coalesce("region", F.lit("TOTAL")))


def method_share(runs: DataFrame) -> DataFrame:
    """Items by extraction method over all runs."""
    return runs.select(F.explode("methods").alias("method", "n")).groupBy("method").agg(F.sum("n").alias("n_items"))


def extraction_bench(items: DataFrame) -> DataFrame:
    """Per city and in total: coverage and precision of extracted dishes.

    ``items`` holds city, restaurant_id, item_name, price; a restaurant
    without items has one row with a null name. Identity is (restaurant, name).
    """
    name = F.trim(F.lower("item_name"))
    per = items.withColumn("_name", name).groupBy("city", "restaurant_id", "_name").agg(
        F.count("item_name").alias("_n"), F.min_by("item_name", "item_name").alias("_shown"), F.max("price").alias("_price"))
    marked = per.withColumns({"_real": F.col("_name").isNotNull(), "_noise": F.col("_name").isNotNull() & looks_noise(F.col("_shown"))})
    sites = marked.groupBy("city", "restaurant_id").agg(
        F.sum("_n").alias("items"), F.count_if("_real").alias("uniq"), F.count_if(F.col("_real") & price_ok(F.col("_price"))).alias("priced"), F.count_if("_noise").alias("noise"))
    return sites.rollup("city").agg(
        F.count("*").alias("restaurants"), F.count_if(F.col("uniq") > 0).alias("with_items"), *[F.sum(c).alias(c) for c in ("items", "uniq", "priced", "noise")]).select(
        F.coalesce("city", F.lit("TOTAL")).alias("city"), "restaurants", "with_items", "items", "uniq", "priced", "noise",
        (F.col("uniq") - F.col("noise")).alias("correct"), F.round(F.col("with_items") / F.col("restaurants") * 100, 1).alias("coverage_pct"),
        F.round((F.col("uniq") - F.col("noise")) / F.col("uniq") * 100, 1).alias("precision_pct"))


def recovery_rate(items: DataFrame, threshold: int = 3) -> DataFrame:
    """Share of chains with at least ``threshold`` dishes carrying allergens."""
    per = items.groupBy("restaurant_id").agg(F.count_if(F.size("allergen_terms") > 0).alias("n"))
    return per.agg(F.count("*").alias("chains"), F.count_if(F.col("n") >= threshold).alias("recovered")).withColumn(
        "rate_pct", F.round(F.col("recovered") / F.col("chains") * 100, 1))


def recognition_scorecard(cuisines: DataFrame, regions: DataFrame, dishes: DataFrame) -> DataFrame:
    """Hits and totals of cuisine, region and dish recognition, and overall.

    Each input holds ok (boolean) per labelled case.
    """
    parts = [df.agg(F.lit(name).alias("part"), F.count_if("ok").alias("hits"), F.count("*").alias("total"))
             for name, df in (("cuisine", cuisines), ("region", regions), ("dish", dishes))]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.rollup("part").agg(F.sum("hits").alias("hits"), F.sum("total").alias("total")).withColumn(
        "part", F.coalesce("part", F.lit("composite"))).withColumn("pct", F.round(F.col("hits") / F.col("total") * 100, 1))


def judged_precision(items: DataFrame, verdicts: DataFrame, failed: DataFrame) -> DataFrame:
    """Precision where each distinct name is judged once.

    A name its judge left out counts as wrong; names of a failed batch count as
    right (an outage must not look like bad extraction).
    """
    names = items.select(norm_ws(F.col("item_name")).alias("name")).where(F.length("name") > 0).distinct()
    joined = names.join(verdicts.select("name", "is_dish"), "name", "left").join(failed.select("name").distinct().withColumn("_failed", F.lit(True)), "name", "left")
    good = F.coalesce("is_dish", "_failed", F.lit(False))
    return joined.agg(F.count("*").alias("n_names"), F.count_if(good).alias("n_dishes")).withColumn(
        "precision", F.round(F.col("n_dishes") / F.col("n_names"), 4))


def cost_model(calls: DataFrame, price_in: float, price_out: float) -> DataFrame:
    """Least-squares tokens ~ a + b * chars, and the cost of every configuration.

    ``calls`` holds config, chars, tokens, out_tokens.
    """
    fit = calls.agg(F.regr_intercept("tokens", "chars").alias("a"), F.regr_slope("tokens", "chars").alias("b"), F.avg("out_tokens").alias("out"))
    totals = calls.groupBy("config").agg(F.count("*").alias("calls"), F.sum("chars").alias("chars"))
    # One-row fit beside a few configurations.
    joined = totals.join(F.broadcast(fit), F.lit(True))
    tokens_in = F.col("a") * F.col("calls") + F.col("b") * F.col("chars")
    return joined.select("config", "calls", F.round(tokens_in, 2).alias("tokens_in"), F.round(F.col("out") * F.col("calls"), 2).alias("tokens_out"),
                         F.round(tokens_in * price_in + F.col("out") * F.col("calls") * price_out, 6).alias("cost"))


def span_stats(spans: DataFrame) -> DataFrame:
    """Count, total, maximum and mean of every timed span."""
    return spans.groupBy("span").agg(F.count("*").alias("n"), F.sum("seconds").alias("total"), F.max("seconds").alias("longest"), F.avg("seconds").alias("mean"))


def stage_durations(events: DataFrame) -> DataFrame:
    """Every start with its own completion per run and stage; starts without one are failed.

    ``events`` holds run_id, stage, kind ('stage_start'/'stage_done'), ts. A
    completion belongs to the latest start at or before it, and a start ends
    with its first completion. The look-up works in time slices.
    """
    keys = ["run_id", "stage"]
    marked = events.select(*keys, "kind", "ts", (F.col("kind") == "stage_done").cast("int").alias("_after"))
    begun = carry_forward(marked, keys, "ts", ["ts", "_after"], F.when(F.col("kind") == "stage_start", F.col("ts")), "_begun")
    done = begun.where((F.col("kind") == "stage_done") & F.col("_begun").isNotNull()).groupBy(*keys, F.col("_begun").alias("started_at")).agg(F.min("ts").alias("done_at"))
    starts = events.where(F.col("kind") == "stage_start").select(*keys, F.col("ts").alias("started_at")).distinct()
    seconds = (F.unix_micros("done_at") - F.unix_micros("started_at")) / 1e6
    return starts.join(done, [*keys, "started_at"], "left").select(*keys, "started_at", seconds.alias("seconds"),
                                                                   F.when(F.col("done_at").isNotNull(), "done").otherwise("failed").alias("status"))


def drift(base: DataFrame, current: DataFrame) -> DataFrame:
    """Rows only in the baseline and rows only in the current output."""
    return base.exceptAll(current).withColumn("side", F.lit("baseline")).unionByName(current.exceptAll(base).withColumn("side", F.lit("current")))


def bench_diff(base: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Recall regressions, tier flips and item losses between two runs, and a verdict."""
    joined = base.select(key, *[F.col(c).alias(f"b_{c}") for c in ("items", "allergen_items", "tier")]).join(current, key)
    regress, flips = F.col("allergen_items") < F.col("b_allergen_items"), ~F.col("tier").eqNullSafe(F.col("b_tier"))
    return joined.agg(F.count_if(regress).alias("regressions"), F.count_if(flips).alias("tier_flips"),
                      F.count_if(F.col("items") < F.col("b_items")).alias("item_losses")).withColumn(
        "verdict", F.when((F.col("regressions") > 0) | (F.col("tier_flips") > 0), "FAIL").otherwise("PASS"))


def set_relation(groups: DataFrame, left: str, right: str) -> DataFrame:
    """Overlap, subset and intersection size of two array columns."""
    return groups.withColumns({"overlaps": F.arrays_overlap(left, right), "is_subset": F.size(F.array_except(left, right)) == 0,
                               "n_common": F.size(F.array_intersect(left, right))})


def clean_history(history: DataFrame, keep: int | None = None) -> DataFrame:
    """Rated visits, or the first ``keep`` of them, of a user: name, rating 1..10 and note, sanitised.

    ``history`` holds user_id, visit_ord, name, rating (text), note.
    """
    name = F.substring(F.trim("name"), 1, 120)
    rating = F.col("rating").try_cast("int")
    usable = history.where((F.length(name) > 0) & rating.isNotNull())
    first = keep_first(usable, ["user_id"], [F.asc("visit_ord")], keep, rank="position")
    return first.select("user_id", "position", name.alias("name"), F.least(F.lit(10), F.greatest(F.lit(1), rating)).alias("rating"),
                        F.substring(F.trim(F.coalesce("note", F.lit(""))), 1, 300).alias("note"))


def validate_required(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with the names of their missing fields)."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]))
    marked = df.withColumn("missing", missing)
    return marked.where(F.size("missing") == 0).drop("missing"), marked.where(F.size("missing") > 0)


