"""Evaluation aggregates over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dinesight.catalog import query
from dinesight.catalog.scoring_queries import ALL_PREFS, DIET_SQL, KB, diet_rows, doubles
from dinesight.catalog.tables import DISHES_SQL, PLACES_SQL, dishes, pick, pick_sql, places, table, with_tables
from dinesight.functions import urls as u
from dinesight.operators import entities as e
from dinesight.operators import evaluation as v
from dinesight.plans import ranking as plan

_CUISINES = ["thai", "italian", "american", "japanese", "vegan"]
_TIERS = ["avoid", "caution", "likely_ok"]


def labelled(spark, sf_dir):
    """Documents with labels as labelled restaurants."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    n = F.col("doc_id")
    return d.select("doc_id", pick(_CUISINES, n).alias("cuisine"), F.when(F.col("toxic") == 1, "pos").when(F.col("quality") == 0, "pos").otherwise("neg").alias("truth"),
                    pick(_TIERS, n * 3 + F.col("quality")).alias("tier"), (n % 2 == 0).alias("grounded"), (n % 5 * 0.15 + 0.1).alias("baseline"), F.col("n_chars").alias("chars"))


LABELLED_SQL = (f"SELECT doc_id, {pick_sql(_CUISINES, 'doc_id')} AS cuisine, CASE WHEN toxic = 1 OR quality = 0 THEN 'pos' ELSE 'neg' END AS truth, {pick_sql(_TIERS, 'doc_id * 3 + quality')} AS tier, doc_id % 2 = 0 AS grounded, "
                "doc_id % 5 * 0.15e0 + 0.1e0 AS baseline, n_chars AS chars FROM documents JOIN labels USING (doc_id)")


@query("safety_eval", "AG-19", with_tables(
    "SELECT coalesce(cuisine, 'TOTAL') AS cuisine, count(*) FILTER (truth = 'pos') AS n_pos, count(*) FILTER (truth = 'pos' AND tier = 'likely_ok') AS n_missed, count(*) FILTER (truth = 'neg') AS n_neg, count(*) FILTER (truth = 'neg' AND tier = 'avoid') AS n_overwarned, "
    "count(*) FILTER (truth = 'pos' AND grounded) AS n_grounded_pos, count(*) FILTER (truth = 'pos' AND tier = 'likely_ok' AND grounded) AS n_grounded_missed FROM labelled GROUP BY ROLLUP (cuisine)", labelled=LABELLED_SQL))
def safety_eval(spark, sf_dir):
    return v.safety_eval(labelled(spark, sf_dir))


@query("calibrate_baselines", "AG-20", with_tables(
    "SELECT cuisine, pos, n, round(emp, 6) AS empirical, round(emp - cur, 6) AS delta, CASE WHEN n < 3 THEN 'low-n' WHEN emp - cur >= 0.2 THEN 'REVISIT' WHEN emp - cur <= -0.2 THEN 'revisit' ELSE '' END AS flag FROM "
    "(SELECT cuisine, count(*) FILTER (truth = 'pos') AS pos, count(*) AS n, (count(*) FILTER (truth = 'pos') + 0.5e0) / (count(*) + 1e0) AS emp, max(baseline) AS cur FROM labelled GROUP BY 1)", labelled=LABELLED_SQL))
def calibrate_baselines(spark, sf_dir):
    out = v.calibrate_baselines(labelled(spark, sf_dir))
    return out.select("cuisine", "pos", "n", F.round("empirical", 6).alias("empirical"), F.round("delta", 6).alias("delta"), "flag")


@query("spearman", "AG-21",
       "SELECT round(corr(rx, ry), 6) AS rho, count(*) AS n FROM (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2e0 AS rx, "
       "rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2e0 AS ry FROM lineitem)")
def spearman(spark, sf_dir):
    return v.spearman(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice").select(F.round("rho", 6).alias("rho"), "n")


@query("tier_matrix", "AG-22", doubles(with_tables(
    "SELECT allergen, count(*) FILTER (tier = 'avoid') AS avoid, count(*) FILTER (tier = 'caution') AS caution, count(*) FILTER (tier = 'likely_ok') AS likely_ok FROM all_scored GROUP BY 1", **ALL_PREFS)))
def tier_matrix(spark, sf_dir):
    return v.tier_matrix(plan.assessed(spark, sf_dir, kb=KB))


@query("verdict_matrix", "AG-22", with_tables(
    "SELECT diet, count(*) FILTER (verdict = 'good_options') AS good_options, count(*) FILTER (verdict = 'limited') AS limited, count(*) FILTER (verdict = 'not_compatible') AS not_compatible, count(*) FILTER (verdict = 'unknown') AS \"unknown\" FROM diets GROUP BY 1",
    dishes=DISHES_SQL, diets=DIET_SQL))
def verdict_matrix(spark, sf_dir):
    return v.verdict_matrix(diet_rows(spark, sf_dir))


@query("chain_scorecard", "AG-23", """
    SELECT coalesce(region, 'TOTAL') AS region, count(*) AS n_chains, count(*) FILTER (items > 0) AS n_with_menu, count(*) FILTER (allergen > 0) AS n_with_allergens, CAST(sum(items) AS BIGINT) AS n_items,
      CAST(sum(allergen) AS BIGINT) AS n_allergen_items, median(items) AS median_items FROM (SELECT c_custkey, list_extract(['US', 'Canada', 'UK + DE', 'Asia-Oceania'], CAST(c_custkey % 4 AS INTEGER) + 1) AS region,
      CASE WHEN c_custkey % 6 = 0 THEN 0 ELSE c_custkey % 90 END AS items, c_custkey % 7 AS allergen FROM customer) GROUP BY ROLLUP (region)""")
def chain_scorecard(spark, sf_dir):
    k = F.col("c_custkey")
    runs = table(spark, sf_dir, "customer").select(pick(["US", "CA", "GB", "JP"], k).alias("home_country"), F.when(k % 6 == 0, 0).otherwise(k % 90).alias("item_count"),
                                                   (k % 7).alias("allergen_item_count"), F.lit(1.0).alias("elapsed_s"))
    return v.chain_scorecard(runs).drop("mean_seconds")


_NOISY = ["", " with", " and Rice and Rice and"]


@query("extraction_bench", "AG-24", with_tables(
    "SELECT coalesce(city, 'TOTAL') AS city, count(*) AS restaurants, count(*) FILTER (uniq > 0) AS with_items, CAST(sum(items) AS BIGINT) AS items, CAST(sum(uniq) AS BIGINT) AS uniq, CAST(sum(priced) AS BIGINT) AS priced FROM (SELECT city, restaurant_id, "
    "CAST(sum(n) AS BIGINT) AS items, count(nm) AS uniq, count(*) FILTER (nm IS NOT NULL AND price LIKE '%$%') AS priced FROM (SELECT city, restaurant_id, nm, count(item_name) AS n, max(price) AS price FROM (SELECT restaurant_id, "
    f"{pick_sql(['Cupertino', 'London', 'Oslo'], 'k')} AS city, CASE WHEN k % 8 <> 0 THEN lower(trim(item_name)) END AS nm, CASE WHEN k % 8 <> 0 THEN item_name END AS item_name, price FROM dishes) GROUP BY ALL) GROUP BY ALL) GROUP BY ROLLUP (city)", dishes=DISHES_SQL))
def extraction_bench(spark, sf_dir):
    k = F.col("k")
    items = dishes(spark, sf_dir).select(pick(["Cupertino", "London", "Oslo"], k).alias("city"), "restaurant_id", F.when(k % 8 != 0, F.col("item_name")).alias("item_name"), "price")
    return v.extraction_bench(items).select("city", "restaurants", "with_items", "items", "uniq", "priced")


@query("recovery_rate", "AG-25", with_tables(
    "SELECT count(*) AS chains, count(*) FILTER (n >= 300) AS recovered, round(count(*) FILTER (n >= 300) / CAST(count(*) AS DOUBLE) * 100, 1) AS rate_pct FROM (SELECT restaurant_id, count(*) FILTER (len(allergen_terms) > 0) AS n FROM dishes GROUP BY 1)", dishes=DISHES_SQL))
def recovery_rate(spark, sf_dir):
    return v.recovery_rate(dishes(spark, sf_dir), 300)


@query("recognition_scorecard", "AG-26")
def recognition_scorecard(spark, sf_dir):
    from dinesight.operators.tagging import dish_hits, dish_text
    rows = places(spark, sf_dir)
    cuisines = rows.select((F.size(e.normalize_cuisines(F.col("categories"))) > 0).alias("ok"))
    regions = rows.select((u.region_from_address(F.col("address"), F.col("latitude"), F.col("longitude")) != "unknown").alias("ok"))
    named = dishes(spark, sf_dir).select("item_name").distinct()
    found = named.select((F.size(dish_hits(dish_text(F.col("item_name"), F.lit("")))) > 0).alias("ok"))
    return v.recognition_scorecard(cuisines, regions, found)


@query("judged_precision", "AG-27", with_tables(
    "SELECT count(*) AS n_names, count(*) FILTER (CASE WHEN length(n) % 4 = 0 THEN false WHEN length(n) % 4 = 1 THEN true ELSE length(n) % 3 = 0 END) AS n_dishes, round(count(*) FILTER (CASE WHEN length(n) % 4 = 0 THEN false WHEN length(n) % 4 = 1 THEN true ELSE length(n) % 3 = 0 END) / CAST(count(*) AS DOUBLE), 4) AS precision "
    "FROM (SELECT DISTINCT lower(item_name) AS n FROM dishes)", dishes=DISHES_SQL))
def judged_precision(spark, sf_dir):
    items = dishes(spark, sf_dir)
    names = items.select(F.lower("item_name").alias("name")).distinct()
    size = F.length("name")
    return v.judged_precision(items, names.where(size % 4 >= 2).select("name", (size % 3 == 0).alias("is_dish")), names.where(size % 4 == 1))


@query("cost_model", "AG-28",
       "SELECT config, count(*) AS calls, round(a * count(*) + b * sum(chars), 2) AS tokens_in, round(o * count(*), 2) AS tokens_out FROM (SELECT source AS config, CAST(n_chars AS DOUBLE) AS chars FROM documents), "
       "(SELECT regr_intercept(n_chars / 4e0 + doc_id % 9, CAST(n_chars AS DOUBLE)) AS a, regr_slope(n_chars / 4e0 + doc_id % 9, CAST(n_chars AS DOUBLE)) AS b, avg(CAST(doc_id % 50 AS DOUBLE)) AS o FROM documents) GROUP BY config, a, b, o")
def cost_model(spark, sf_dir):
    calls = table(spark, sf_dir, "documents").select(F.col("source").alias("config"), F.col("n_chars").cast("double").alias("chars"),
                                                     (F.col("n_chars") / 4.0 + F.col("doc_id") % 9).alias("tokens"), (F.col("doc_id") % 50).cast("double").alias("out_tokens"))
    return v.cost_model(calls, 1e-7, 4e-7).select("config", "calls", "tokens_in", "tokens_out")


@query("span_stats", "AG-29", "SELECT event_type AS span, count(*) AS n, round(sum(value), 3) AS total, max(value) AS longest, round(avg(value), 4) AS mean FROM events GROUP BY 1")
def span_stats(spark, sf_dir):
    spans = table(spark, sf_dir, "events").select(F.col("event_type").alias("span"), F.col("value").alias("seconds"))
    return v.span_stats(spans).select("span", "n", F.round("total", 3).alias("total"), "longest", F.round("mean", 4).alias("mean"))


@query("stage_durations", "WI-16",
       "WITH e AS (SELECT user_id AS run_id, CAST(ts AS DATE) AS stage, event_type = 'purchase' AS d, ts FROM events WHERE event_type IN ('signup', 'purchase')), "
       "b AS (SELECT *, max(CASE WHEN NOT d THEN ts END) OVER (PARTITION BY run_id, stage ORDER BY ts, d RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM e), "
       "c AS (SELECT run_id, stage, s, min(ts) AS t FROM b WHERE d AND s IS NOT NULL GROUP BY ALL) "
       "SELECT run_id, stage, epoch_us(s) AS started_us, CASE WHEN t IS NULL THEN 'failed' ELSE 'done' END AS status, round((epoch_us(t) - epoch_us(s)) / 1e6, 3) AS seconds "
       "FROM (SELECT DISTINCT run_id, stage, ts AS s FROM e WHERE NOT d) LEFT JOIN c USING (run_id, stage, s)")
def stage_durations(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    kind = F.when(F.col("event_type") == "signup", "stage_start").when(F.col("event_type") == "purchase", "stage_done")
    events = rows.select(F.col("user_id").alias("run_id"), F.to_date("ts").alias("stage"), kind.alias("kind"), "ts").where("kind IS NOT NULL")
    return v.stage_durations(events).select("run_id", "stage", F.unix_micros("started_at").alias("started_us"), "status", F.round("seconds", 3).alias("seconds"))


@query("drift", "SE-4",
       "SELECT * FROM (SELECT o_orderstatus, o_orderpriority, 'baseline' AS side FROM (SELECT o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 2 = 0 EXCEPT ALL SELECT o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 2 = 1) "
       "UNION ALL SELECT o_orderstatus, o_orderpriority, 'current' FROM (SELECT o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 2 = 1 EXCEPT ALL SELECT o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 2 = 0))")
def drift(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    pick_columns = ("o_orderstatus", "o_orderpriority")
    return v.drift(orders.where("o_orderkey % 2 = 0").select(*pick_columns), orders.where("o_orderkey % 2 = 1").select(*pick_columns))


@query("bench_diff", "SE-5", with_tables(
    "SELECT count(*) FILTER (k % 7 < k % 5) AS regressions, count(*) FILTER (k % 11 = 0) AS tier_flips, count(*) FILTER (k % 13 < k % 3) AS item_losses, 'FAIL' AS verdict FROM places", places=PLACES_SQL))
def bench_diff(spark, sf_dir):
    k = F.col("k")
    rows = places(spark, sf_dir)
    base = rows.select("restaurant_id", (k % 3).alias("items"), (k % 5).alias("allergen_items"), F.lit("caution").alias("tier"))
    current = rows.select("restaurant_id", (k % 13).alias("items"), (k % 7).alias("allergen_items"), F.when(k % 11 == 0, "avoid").otherwise("caution").alias("tier"))
    return v.bench_diff(base, current, "restaurant_id")


@query("set_relation", "SE-3", with_tables(
    "SELECT arrival, list_has_any(allergen_terms, matrix_allergen_columns) AS overlaps, len(list_filter(allergen_terms, lambda t: NOT list_contains(matrix_allergen_columns, t))) = 0 AS is_subset, "
    "CAST(len(list_intersect(allergen_terms, matrix_allergen_columns)) AS INTEGER) AS n_common FROM dishes", dishes=DISHES_SQL))
def set_relation(spark, sf_dir):
    return v.set_relation(dishes(spark, sf_dir), "allergen_terms", "matrix_allergen_columns").select("arrival", "overlaps", "is_subset", "n_common")


@query("clean_history", "PR-37",
       "SELECT user_id, CAST(rn AS INTEGER) AS position, event_type AS name, least(10, greatest(1, CAST(trunc(value) AS INTEGER))) AS rating FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events WHERE event_id % 9 <> 0)")
def clean_history(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("visit_ord"), F.concat(F.lit(" "), "event_type").alias("name"),
                                                 F.when(F.col("event_id") % 9 == 0, "bad").otherwise(F.floor("value").cast("string")).alias("rating"), F.lit(None).cast("string").alias("note"))
    return v.clean_history(rows).select("user_id", "position", "name", "rating")


@query("validate_required", "FI-7", with_tables(
    "SELECT restaurant_id, array_to_string(list_filter([CASE WHEN name IS NULL THEN 'name' END, CASE WHEN address IS NULL THEN 'address' END, CASE WHEN website_url IS NULL THEN 'website_url' END], lambda z: z IS NOT NULL), ',') AS missing FROM places "
    "WHERE name IS NULL OR address IS NULL OR website_url IS NULL", places=PLACES_SQL))
def validate_required(spark, sf_dir):
    rejected = v.validate_required(places(spark, sf_dir), ["name", "address", "website_url"])[1]
    return rejected.select("restaurant_id", F.array_join("missing", ",").alias("missing"))


@query("lenient_casts", "SC-5",
       "SELECT o_orderkey, o_custkey AS review_count, o_totalprice AS rating, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey % 2 = 0 AS BOOLEAN) END AS is_open_now, "
       "replace(o_orderpriority, '-', '|') AS categories FROM orders")
def lenient_casts(spark, sf_dir):
    from dinesight.sources.records import with_schema
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string"), F.concat(F.lit(" "), F.col("o_custkey").cast("string")).alias("review_count"), F.col("o_totalprice").cast("string").alias("rating"),
        F.when(F.col("o_orderkey") % 3 == 0, "maybe").otherwise((F.col("o_orderkey") % 2 == 0).cast("string")).alias("is_open_now"),
        F.concat(F.replace(F.col("o_orderpriority"), F.lit("-"), F.lit(" ;")), F.lit("; ")).alias("categories"))
    cast = with_schema(rows, "o_orderkey BIGINT, review_count BIGINT, rating DOUBLE, is_open_now BOOLEAN, categories ARRAY<STRING>")
    return cast.withColumn("categories", F.array_join("categories", "|"))


@query("evidence_ids", "WI-13",
       "SELECT restaurant_id, ordinal, 'E' || CAST(row_number() OVER (PARTITION BY restaurant_id ORDER BY ordinal) AS VARCHAR) AS evidence_id "
       "FROM (SELECT conv_id % 100 AS restaurant_id, conv_id * 4294967296 + turn AS ordinal FROM conversations)")
def evidence_ids(spark, sf_dir):
    from dinesight.operators.common import numbered
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 100).alias("restaurant_id"), (F.col("conv_id") * 4294967296 + F.col("turn")).alias("ordinal"))
    out = numbered(rows, ["restaurant_id"], "ordinal", "_n", width=50_000 * 4294967296)
    return out.select("restaurant_id", "ordinal", F.concat(F.lit("E"), F.col("_n").cast("string")).alias("evidence_id"))
