"""Coverage, contribution and card aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dinesight.functions.literals import lookup, text_array
from dinesight.functions.text import has_value
from dinesight.functions.urls import (
    city_from_address, country_label, host, labeling_trust, menu_city_mismatch, source_city_slug, url_has_city)
from dinesight.operators.common import grown, keep_first
from dinesight.operators.entities import cuisine_prior
from dinesight.session import cut_lineage
from dinesight.vocab import scoring as sv


def restaurant_risk_rollup(scored: DataFrame, cuisines: Column, region: Column, top: int = 5) -> DataFrame:
    """Menu-level prior: worst dish over the kitchen's floor, and the top dishes."""
    # One pass over the dishes: both the totals and the top read one kept row per restaurant and name.
    base = cuisine_prior(cuisines, region)["risk"]
    dishes = cut_lineage(scored.groupBy("restaurant_id", "item_name").agg(
        F.max(base).alias("_b"), F.max("prior_risk").alias("_r"), F.count_if(F.col("prior_risk") >= 0.5).alias("_n")))
    totals = dishes.groupBy("restaurant_id").agg(F.max("_b").alias("_base"), F.max("_r").alias("_top"), F.sum("_n").alias("n_risky"))
    first = keep_first(dishes, ["restaurant_id"], [F.desc("_r"), F.asc("item_name")], top, rank="_p")
    names = first.groupBy("restaurant_id").agg(F.array_sort(F.collect_list(F.struct("_p", "item_name"))).alias("_t"))
    return totals.join(names, "restaurant_id").select(
        "restaurant_id", F.greatest("_base", "_top").alias("risk"), F.when(F.col("n_risky") > 0, 0.8).otherwise(0.55).alias("confidence"),
        "n_risky", F.col("_t.item_name").alias("top_items"))


def menu_summary(items: DataFrame) -> DataFrame:
    """Counts by method, source type and category of every restaurant, one pass."""
    category = F.when(has_value(F.col("category")), F.col("category")).otherwise("Uncategorized")
    keyed = items.select("restaurant_id", "extraction_method", "source_type", category.alias("category"), "price", "dietary_terms", "allergen_terms")
    sets = [["restaurant_id"], ["restaurant_id", "extraction_method"], ["restaurant_id", "source_type"], ["restaurant_id", "category"]]
    grouped = keyed.groupingSets(sets, "restaurant_id", "extraction_method", "source_type", "category").agg(
        F.grouping_id().alias("_g"), F.count("*").alias("n_items"), F.count_if(has_value(F.col("price"))).alias("n_priced"),
        F.count_if(F.size("dietary_terms") > 0).alias("n_dietary"), F.count_if(F.size("allergen_terms") > 0).alias("n_allergen"))
    kind = lookup(F.col("_g").cast("string"), {"7": "total", "3": "method", "5": "source_type", "6": "category"})
    return grouped.select("restaurant_id", kind.alias("kind"), F.coalesce("extraction_method", "source_type", "category", F.lit("all")).alias("value"),
                          "n_items", "n_priced", "n_dietary", "n_allergen")


def sorted_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts by value, most frequent first, then by name."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(column))


def coverage_status(restaurants: DataFrame, sources: DataFrame, texts: DataFrame, items: DataFrame) -> DataFrame:
    """menu_backed / cuisine_estimate / no_menu_found per restaurant."""
    real = items.groupBy("restaurant_id").agg(F.bool_or(F.col("source_type") != "community").alias("_real"))
    hints = sources.select("restaurant_id").unionByName(texts.select("restaurant_id")).distinct().withColumn("_hint", F.lit(True))
    joined = restaurants.select("restaurant_id").join(real, "restaurant_id", "left").join(hints, "restaurant_id", "left")
    status = F.when(F.col("_real"), "menu_backed").when(F.col("_real").isNotNull() | F.col("_hint"), "cuisine_estimate").otherwise("no_menu_found")
    return joined.select("restaurant_id", status.alias("coverage_status"))


def _contributions(df: DataFrame, by: str, **measures: Column) -> DataFrame:
    """Records, distinct restaurants and measures per value.

    Restaurants are deduplicated per value before counting, so one value that
    covers most rows still combines map-side.
    """
    key = F.when(has_value(F.col(by)), F.col(by)).otherwise("n/a")
    first = df.select(key.alias(by), "restaurant_id", *[c.alias(n) for n, c in measures.items()]).groupBy(by, "restaurant_id").agg(
        F.count("*").alias("records"), *[F.sum(n).alias(n) for n in measures])
    return first.groupBy(by).agg(F.sum("records").alias("records"), F.count("restaurant_id").alias("restaurants"), *[F.sum(n).alias(n) for n in measures])


def item_contributions(items: DataFrame, by: str) -> DataFrame:
    return _contributions(items, by, priced_items=has_value(F.col("price")).cast("bigint"), dietary_items=(F.size("dietary_terms") > 0).cast("bigint"),
                          allergen_items=(F.size("allergen_terms") > 0).cast("bigint"))


def text_contributions(texts: DataFrame, by: str) -> DataFrame:
    return _contributions(texts, by, chars=F.col("char_count").cast("bigint"), prices=F.col("price_count").cast("bigint"))


def restaurant_coverage(sources: DataFrame, restaurants: DataFrame) -> DataFrame:
    """Restaurants inspected, with candidates, with validated candidates."""
    per = sources.where(has_value(F.col("restaurant_id"))).groupBy("restaurant_id").agg(F.bool_or(F.col("validation_status") == "validated").alias("_v"))
    counted = per.agg(F.count("*").alias("with_candidates"), F.count_if("_v").alias("with_validated"))
    inspected = restaurants.select("restaurant_id").distinct().agg(F.count("*").alias("inspected"))
    # Two one-row frames.
    return inspected.join(counted, F.lit(True))


def dashboard_cards(items: DataFrame, texts: DataFrame, restaurants: DataFrame) -> DataFrame:
    """Per restaurant: counts, mean confidence, method counts, text totals, metadata."""
    per_method = items.groupBy("restaurant_id", "extraction_method").agg(
        F.count("*").alias("n"), F.count_if(has_value(F.col("price"))).alias("p"), F.count_if(F.size("dietary_terms") > 0).alias("d"),
        F.count_if(F.size("allergen_terms") > 0).alias("a"), F.sum("confidence").alias("c"))
    cards = per_method.groupBy("restaurant_id").agg(
        F.sum("n").alias("item_count"), F.sum("p").alias("price_count"), F.sum("d").alias("dietary_count"), F.sum("a").alias("allergen_count"),
        F.round(F.sum("c") / F.sum("n"), 2).alias("avg_confidence"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("extraction_method", "n")))).alias("method_counts"))
    text = texts.groupBy("restaurant_id").agg(F.count("*").alias("text_records"), F.sum("char_count").alias("text_chars"))
    return cards.join(text, "restaurant_id", "left").join(restaurants, "restaurant_id", "left").withColumns({
        "text_records": F.coalesce("text_records", F.lit(0)), "text_chars": F.coalesce("text_chars", F.lit(0))})


def cards_order(cards: DataFrame) -> DataFrame:
    """Biggest menus first, then by name."""
    return cards.orderBy(F.desc("item_count"), F.lower("name").asc(), F.asc("restaurant_id"))


def attach_metadata(items: DataFrame, restaurants: DataFrame) -> DataFrame:
    """Dish rows beside their restaurant's metadata."""
    return items.join(restaurants, "restaurant_id", "left")


def compare_surfaces(listed: DataFrame, drawer: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Null-safe comparison of two outputs of the same rows."""
    joined = listed.alias("l").join(drawer.alias("d"), keys)
    return joined.select(*keys, *[F.col(f"l.{c}").eqNullSafe(F.col(f"d.{c}")).alias(f"{c}_match") for c in columns])


def prior_then_upgrade(prior: DataFrame, backed: DataFrame) -> DataFrame:
    """Prior-only cards replaced by menu-backed ones where available."""
    joined = prior.join(backed.select("restaurant_id", *[F.col(c).alias(f"_{c}") for c in ("risk", "tier", "basis")]), "restaurant_id", "left")
    return joined.select("restaurant_id", *[F.coalesce(f"_{c}", c).alias(c) for c in ("risk", "tier", "basis")], F.col("_risk").isNotNull().alias("is_menu_backed"))


def region_notice(restaurants: DataFrame, items: DataFrame, coverage: DataFrame) -> DataFrame:
    """Where the shown data came from relative to the diner's region.

    ``restaurants`` holds restaurant_id, home; ``items`` restaurant_id,
    menu_source_url, allergen_terms; ``coverage`` source_url, region.
    Allergen sources decide; other sources only when there are none.
    """
    used = items.groupBy("restaurant_id", "menu_source_url").agg(F.bool_or(F.size("allergen_terms") > 0).alias("_allergen"), F.min("arrival").alias("_first"))
    has = used.groupBy("restaurant_id").agg(F.bool_or("_allergen").alias("_any"))
    known = used.join(has, "restaurant_id").where(F.col("_allergen") | ~F.col("_any")).join(
        coverage.where(has_value(F.col("region"))).select(F.col("source_url").alias("menu_source_url"), "region"), "menu_source_url").join(
        restaurants.select("restaurant_id", "home"), "restaurant_id")
    foreign = F.col("home").isNull() | (F.col("region") != F.col("home"))
    best = F.min_by("region", F.struct((~foreign).cast("int"), "_first"))
    out = known.groupBy("restaurant_id").agg(F.first("home").alias("home"), best.alias("source_region"))
    return out.select("restaurant_id", "home", "source_region", F.coalesce(F.col("source_region") == F.col("home"), F.lit(False)).alias("verified"),
                      country_label(F.col("source_region")).alias("source_label"))


def location_notice(restaurants: DataFrame, items: DataFrame, coverage: DataFrame) -> DataFrame:
    """Whether the shown menu is another branch's: labeled or inferred."""
    home = city_from_address(F.col("address"))
    used = items.select("restaurant_id", "menu_source_url").distinct().join(restaurants.select("restaurant_id", "name", "address"), "restaurant_id")
    url = F.col("menu_source_url")
    marked = used.withColumns({"_city": home, "_wrong": menu_city_mismatch(url, F.col("address"), F.col("name")), "_here": url_has_city(url, home),
                               "_shown": source_city_slug(url, F.col("name"))})
    rolled = marked.groupBy("restaurant_id").agg(F.max("_city").alias("home_city"), F.bool_or("_wrong").alias("_wrong"), F.bool_or("_here").alias("_used_here"),
                                                 F.min(F.when(F.col("_wrong"), F.col("_shown"))).alias("shown_city"))
    found = coverage.join(restaurants.select("restaurant_id", "address"), "restaurant_id").groupBy("restaurant_id").agg(
        F.bool_or(url_has_city(F.col("url"), city_from_address(F.col("address")))).alias("_found_here"))
    joined = rolled.join(found, "restaurant_id", "left")
    confidence = F.when(F.col("_wrong"), "labeled").when(F.coalesce("_found_here", F.lit(False)) & ~F.col("_used_here"), "inferred")
    return joined.where(has_value(F.col("home_city"))).select("restaurant_id", "home_city", F.coalesce("shown_city", F.lit("")).alias("shown_city"), confidence.alias("confidence")).where(
        "confidence IS NOT NULL")


def used_hosts(items: DataFrame, top: int = 6) -> DataFrame:
    """Most used source hosts of every restaurant."""
    counts = items.groupBy("restaurant_id", host(F.col("menu_source_url")).alias("host")).agg(F.count("*").alias("n"))
    return keep_first(counts, ["restaurant_id"], [F.desc("n"), F.asc("host")], top, rank="position")


def sample_items(items: DataFrame, top: int = 6) -> DataFrame:
    """First dish names of every restaurant."""
    return keep_first(items.select("restaurant_id", "arrival", "item_name"), ["restaurant_id"], [F.asc("arrival")], top, rank="position")


#: Longest lists of a report: watched dishes, quotes, sources; of a bundle: flagged dishes, cited reports, menu lines.
WATCHED, QUOTED, SOURCES, FLAGGED, CITED, MENU_LINES = 8, 12, 40, 20, 20, 60


def _top_list(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], fields: Sequence[str], name: str, limit: int) -> DataFrame:
    """Per key the first ``limit`` rows as an array of structs, and ``n_<name>``, how many there are.

    Ranked before anything is collected: tasks cut their part to ``limit`` rows, so a key of any size stays small.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias(f"n_{name}"))
    first = keep_first(rows, keys, order, limit, rank="_rank")
    listed = first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", *fields))), lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias(name))
    return listed.join(grown(counts), list(keys))


def _counted(name: str) -> Column:
    return F.coalesce(f"n_{name}", F.lit(0)).alias(f"n_{name}")


def dossier(restaurants: DataFrame, verdicts: DataFrame, watch: DataFrame, signals: DataFrame, items: DataFrame | None = None, site: DataFrame | None = None,
            quotes: DataFrame | None = None, sources: DataFrame | None = None, notices: DataFrame | None = None, per_allergen: DataFrame | None = None) -> DataFrame:
    """Nested document per verdict and restaurant; a missing extraction is unverified, never safe.

    ``verdicts`` is keyed by restaurant_id, and by user_id where it has one; restaurants without a verdict get one document. All other
    tables are keyed by restaurant_id and may be left out: ``watch`` (position, name, risk), ``items`` (parsed), ``site`` (pages_scanned, signals,
    social_links, error), ``quotes`` (position, quote), ``sources`` (source_url), ``notices`` (region_notice, location_notice), ``per_allergen``
    (allergen, tier, risk; by user_id where verdicts are). Lists hold their first rows, with their full number beside them.
    """
    key = ["restaurant_id"]
    by_user = [c for c in ("user_id",) if c in verdicts.columns]
    out = restaurants.select("restaurant_id", F.struct("name", "address", F.col("website_url").alias("website"), F.col("phone_number").alias("phone"), "categories").alias("header"))
    # What is told of a restaurant is put together once per restaurant; the verdicts of its users come last.
    out = out.join(grown(_top_list(watch, key, [F.asc("position"), F.asc("name")], ["name", "risk"], "watch", WATCHED)), key, "left")
    out = out.join(grown(signals.select("restaurant_id", F.struct(*[c for c in signals.columns if c != "restaurant_id"]).alias("restaurant_signals"))), key, "left")

    def optional(df: DataFrame | None, make, empty: dict[str, str]) -> None:
        nonlocal out
        out = out.join(grown(make(df)), key, "left") if df is not None else out.withColumns({c: F.lit(None).cast(kind) for c, kind in empty.items()})

    optional(items, lambda d: d.groupBy("restaurant_id").agg(F.sum("parsed").alias("_parsed")), {"_parsed": "bigint"})
    optional(site, lambda d: d.select("restaurant_id", F.struct("pages_scanned", "signals", "social_links", "error").alias("deeper_site")),
             {"deeper_site": "struct<pages_scanned:int,signals:array<string>,social_links:array<string>,error:string>"})
    optional(quotes, lambda d: _top_list(d, key, [F.asc("position"), F.asc("quote")], ["quote"], "quotes", QUOTED), {"quotes": "array<struct<quote:string>>", "n_quotes": "bigint"})
    optional(sources, lambda d: _top_list(d.select("restaurant_id", "source_url").distinct(), key, [F.asc("source_url")], ["source_url"], "sources", SOURCES),
             {"sources": "array<struct<source_url:string>>", "n_sources": "bigint"})
    optional(notices, lambda d: d.select("restaurant_id", "region_notice", "location_notice"), {"region_notice": "string", "location_notice": "string"})
    out = out.withColumns({
        "dishes": F.struct("watch", _counted("watch"), F.coalesce("_parsed", F.lit(0)).alias("parsed_count"),
                           F.greatest(F.lit(0), F.coalesce("_parsed", F.lit(0)) - F.coalesce(F.size("watch"), F.lit(0))).alias("other_count")),
        "community": F.struct(F.transform("quotes", lambda q: q["quote"]).alias("quotes"), _counted("quotes")),
        "_sources": F.transform("sources", lambda q: q["source_url"])}).drop("watch", "n_watch", "_parsed", "quotes", "n_quotes", "sources")
    out = out.join(grown(verdicts), key, "left")
    if per_allergen is not None:
        keys = key + [c for c in by_user if c in per_allergen.columns]
        # One row per pref of a user: bounded by the allergens there are.
        each = per_allergen.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("allergen", "tier", "risk"))).alias("per_allergen"))
        out = out.join(grown(each), keys, "left")
    else:
        out = out.withColumn("per_allergen", F.lit(None).cast("array<struct<allergen:string,tier:string,risk:double>>"))

    verified = F.col("tier").isNotNull()
    verdict = F.struct(F.coalesce("tier", F.lit("unknown")).alias("tier"), "overall_risk", "overall_confidence", F.coalesce("evidence_basis", F.lit("")).alias("basis"), verified.alias("verified"))
    return out.select(
        *by_user, "restaurant_id", "header", verdict.alias("verdict"), "dishes", "restaurant_signals", "deeper_site", "community",
        F.struct(F.col("_sources").alias("sources"), _counted("sources"), "region_notice", "location_notice", "per_allergen").alias("provenance"))


_SIGNAL_LABELS = {
    "allergy_disclaimer": "allergy disclaimer / allergy-aware", "cross_contact_warning": "cross-contact / 'may contain' warning",
    "ask_staff": "tells customers to ask staff about allergies", "allergen_menu_available": "publishes an allergen menu/chart", "nut_free_claim": "explicit nut-free claim"}


def score_bundles(assessments: DataFrame, restaurants: DataFrame, menus: DataFrame, quotes: DataFrame | None = None, flagged: DataFrame | None = None,
                  keys: Sequence[str] = ("user_id", "restaurant_id")) -> DataFrame:
    """Evidence bundle of every assessment for an outside scorer, as JSON; ``keys`` name the row beside its allergen.

    The scenario says which menu the scorer sees: a restaurant with a chart (``chart`` in ``restaurants``, else none has) shows its counts and
    flagged dishes, one with parsed dishes the first of its compact ``menus`` lines (position, line), others
    neither. Evidence is numbered: cuisine, the handling signals that hold, then community reports (``quotes``: type, quote, position). What
    depends on the restaurant only is built once per restaurant.
    """
    key = ["restaurant_id"]
    lines = _top_list(menus, key, [F.asc("position")], ["line"], "_m", MENU_LINES)
    trust = F.format_string("%.2f", labeling_trust(F.col("region")))
    name = F.col("name") if "name" in restaurants.columns else F.lit(None).cast("string")
    cuisine = F.concat(F.when(has_value(name), F.concat(F.lit('Restaurant name: "'), name, F.lit('". '))).otherwise(""), F.lit("Cuisine(s): "),
                       F.when(F.size("cuisines") > 0, F.array_join("cuisines", ", ")).otherwise("unknown; infer the likely cuisine from the name"),
                       F.lit("; region "), F.coalesce("region", F.lit("unknown")), F.lit("; allergen-labeling trust "), trust, F.lit("."))
    entry = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    held = F.array_compact(F.array(*[F.when(F.col(c), entry("handling", F.lit(f"Restaurant signal: {label}."))) for c, label in _SIGNAL_LABELS.items() if c in restaurants.columns]))
    chart = F.col("chart") if "chart" in restaurants.columns else F.lit(False)
    places = restaurants.select("restaurant_id", chart.alias("_chart"), F.concat(F.array(entry("cuisine", cuisine)), held).alias("_e")).join(grown(lines), key, "left")
    if quotes is not None:
        cited = _top_list(quotes, key, [F.asc("position"), F.asc("type"), F.asc("quote")], ["type", "quote"], "cited", CITED)
        places = places.join(grown(cited), key, "left").withColumn("_e", F.concat("_e", F.coalesce(F.transform("cited", lambda q: entry("community", F.concat(
            F.lit("Community "), q["type"], F.lit(': "'), F.substring(F.coalesce(q["quote"], F.lit("")), 1, 140), F.lit('".')))), F.expr("CAST(array() AS ARRAY<STRUCT<type: STRING, text: STRING>>)"))))
    if flagged is not None:
        places = places.join(grown(_top_list(flagged, key, [F.asc("position"), F.asc("name")], ["name"], "flagged", FLAGGED)), key, "left")
    else:
        places = places.withColumn("flagged", F.lit(None).cast("array<struct<name:string>>"))
    scenario = F.when(F.col("_chart"), "labeled").when(F.size("_m") > 0, "raw_menu").otherwise("no_menu")
    numbered = F.transform("_e", lambda e, i: F.struct(F.concat(F.lit("E"), (i + 1).cast("string")).alias("id"), e["type"].alias("type"), e["text"].alias("text")))
    # JSON of what depends on the restaurant only is written once per restaurant; every pref puts its few fields in between.
    places = places.withColumns({"scenario": scenario, "_e": numbered})
    before = _json_fields(F.struct("scenario"))
    evidence = _json_fields(F.struct(F.col("_e").alias("evidence")))
    summary = _json_fields(F.struct(F.coalesce(F.transform("flagged", lambda x: x["name"]), text_array([])).alias("flagged_dishes")))
    menu = _json_fields(F.struct(F.when(F.col("scenario") == "raw_menu", F.col("_m.line")).alias("menu")))
    places = places.select("restaurant_id", "scenario", before.alias("_before"), evidence.alias("_evidence"), F.when(F.col("scenario") == "labeled", summary).alias("_summary"), menu.alias("_menu"))
    joined = assessments.join(grown(places), key)
    pref = _json_fields(F.struct(F.struct("allergen", "severity").alias("user"),
                                 F.struct("risk", "tier", "basis", F.col("basis").isin(list(sv.GROUNDED_BASES)).alias("grounded_presence")).alias("deterministic_baseline")))
    counts = _json_fields(F.struct(F.col("menu_total").alias("total_dishes"), F.col("menu_flagged").alias("dishes_with_allergen")))
    charted = F.when(F.col("_summary").isNotNull(), F.concat(F.lit('"chart_summary":{'), F.concat_ws(",", counts, "_summary"), F.lit("}")))
    bundle = F.concat(F.lit("{"), F.concat_ws(",", "_before", pref, "_evidence", charted, "_menu"), F.lit("}"))
    return joined.select(*keys, "allergen", "scenario", bundle.alias("bundle"))


def _json_fields(value: Column) -> Column:
    """The fields of a struct as they stand inside its JSON, null where it has none."""
    text = F.to_json(value)
    return F.when(F.length(text) > 2, F.substring(text, F.lit(2), F.length(text) - 2))
