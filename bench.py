"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from dinesight.catalog import load
from dinesight.session import build_session

HEADLINE = [
    "tag_terms", "infer_ingredient_allergens", "item_prior", "dedupe_items_across_sources", "union_evidence", "collapse_components",
    "score_nuts", "rank_for_user", "diet_assessment", "menu_summary", "extract_links", "visible_lines", "ground_names",
    "nearby", "match_entities", "lookup_registry", "latest_valid_cache", "attempts_last_60s", "spearman", "client_rate",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", master=f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus})
    spark.sparkContext.setLogLevel("ERROR")
    entries = load()
    # Start the JVM's scan and codegen paths before timing.
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("sum(l_quantity)").collect()
    seconds = {}
    for name in HEADLINE:
        started = time.time()
        entries[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
