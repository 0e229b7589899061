"""Places: matching across providers, nearby search, registry, cuisines."""

from __future__ import annotations

import json
import logging
import math
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dinesight.functions import geo
from dinesight.functions.literals import contains_any, first_letters, let, letter_tree, lookup, text_array
from dinesight.functions.text import blank_to_empty, has_value, norm_key, norm_ws
from dinesight.functions.urls import entity_compact, host, netloc, registrable_domain
from dinesight.operators.common import keep_first
from dinesight.operators.components import components
from dinesight.operators.tagging import match_table
from dinesight.session import cut_lineage
from dinesight.vocab import cuisines as cv
from dinesight.vocab import places as pv

_log = logging.getLogger(__name__)
QUALITY_KINDS = {name: ("collection" if name == "categories" else "string") for name in pv.QUALITY_FIELDS}


# --- Food filter ----------------------------------------------------------------
def is_food_place(categories: Column) -> Column:
    """Non-food primary type loses, food primary wins, then any tokens."""
    lows = F.transform(F.filter(categories, lambda c: F.length(F.trim(c)) > 0), lambda c: F.trim(F.lower(c)))
    primary = F.coalesce(F.get(F.transform(F.filter(lows, lambda c: c.startswith("primary_type:")),
                                           lambda c: F.regexp_replace(c, "^[^:]*:", "")), F.lit(0)), F.lit(""))
    tokens = F.transform(lows, lambda c: F.trim(F.regexp_replace(c, "^[^:]*:", "")))
    joined = F.array_join(tokens, "\n")
    return F.coalesce(
        F.when(contains_any(primary, pv.NON_FOOD_TYPES), False).when(contains_any(primary, pv.FOOD_TYPES), True)
        .when(contains_any(joined, pv.NON_FOOD_TYPES), False).otherwise(contains_any(joined, pv.FOOD_TYPES)), F.lit(False))


# --- Cuisines -------------------------------------------------------------------
def normalize_cuisines(categories: Column) -> Column:
    """Canonical cuisines of provider categories, first occurrence order."""
    def tokens(raw: Column) -> Column:
        value = F.regexp_replace(F.lower(F.trim(raw)), "^[^:]*:", "")
        value = F.replace(F.replace(value, F.lit("catering."), F.lit("")), F.lit("restaurant."), F.lit(""))
        pieces = F.transform(F.split(value, "[;.,/]"), lambda p: F.regexp_replace(
            F.replace(F.trim(p), F.lit(" "), F.lit("_")), "_restaurant$", ""))
        return F.transform(pieces, lambda p: F.coalesce(lookup(p, cv.CUISINE_ALIASES),
                                                        lookup(F.replace(p, F.lit("_"), F.lit(" ")), cv.CUISINE_ALIASES)))

    found = F.flatten(F.transform(F.coalesce(categories, text_array([])), tokens))
    return F.array_distinct(F.array_compact(found))


def infer_from_name(name: Column) -> Column:
    """Canonical cuisines whose cue is a whole word of the name, in cue order.

    One scan finds the longest cue of every word start; a shorter one there ends at an edge inside the longer.
    """
    cues = list(cv.NAME_HINTS)
    edge = r"[\p{L}\p{N}_]"
    scan = rf"{first_letters(cues)}(?<!{edge})(?=({letter_tree(cues)})(?!{edge}))"

    def inside(long: str) -> list[dict]:
        return [{"ord": i, "cuisine": cv.NAME_HINTS[cue]} for i, cue in enumerate(cues)
                if long.startswith(cue) and not re.match(r"\w", long[len(cue):])]

    by_cue = F.from_json(F.lit(json.dumps({cue: inside(cue) for cue in cues}, ensure_ascii=False)), "map<string,array<struct<ord:int,cuisine:string>>>")
    hits = F.array_distinct(F.regexp_extract_all(norm_ws(name), F.lit(scan), F.lit(1)))
    return F.array_distinct(F.transform(F.array_sort(F.flatten(F.transform(hits, lambda cue: F.element_at(by_cue, cue)))), lambda r: r.cuisine))


def cuisines_for(categories: Column, name: Column) -> Column:
    """Category cuisines, falling back to the name's."""
    found = normalize_cuisines(categories)
    return F.when(F.size(found) > 0, found).otherwise(infer_from_name(name))


def cuisine_prior(cuisines: Column, region: Column) -> Column:
    """struct(base, risk, confidence, basis) of the nut prior of a kitchen."""
    def prior(cuisines: Column) -> Column:
        risks = F.transform(cuisines, lambda c: F.coalesce(lookup(c, cv.CUISINE_BASELINE), F.lit(cv.DEFAULT_CUISINE_BASELINE)))
        empty = F.coalesce(F.size(cuisines), F.lit(0)) <= 0
        base = F.when(empty, cv.DEFAULT_CUISINE_BASELINE).otherwise(F.array_max(risks))
        return F.struct(base.alias("base"), boost_at_home(base, cuisines, region, 0.25).alias("risk"),
                        F.when(empty, 0.25).otherwise(0.4).alias("confidence"),
                        F.when(empty, "default").otherwise("cuisine_baseline").alias("basis"))

    return let(cuisines, prior)


def at_home(cuisines: Column, region: Column) -> Column:
    """Any of the cuisines is traditional in this country."""
    homes = {c: ",".join(codes) for c, codes in cv.CUISINE_HOME.items()}
    return F.coalesce((region != "unknown") & F.exists(cuisines, lambda c: F.array_contains(
        F.split(F.coalesce(lookup(c, homes), F.lit("")), ","), region)), F.lit(False))


def boost_at_home(risk: Column, cuisines: Column, region: Column, weight: float) -> Column:
    return F.when(at_home(cuisines, region), F.greatest(F.lit(0.0), F.least(F.lit(cv.MAX_RISK), risk * (1 + weight)))).otherwise(risk)


def generic_cuisine_prior(cuisines: Column, region: Column, baseline: Column) -> Column:
    """Baseline of one allergen: its default raised by any listed cuisine.

    ``baseline`` is map<cuisine, risk> with a ``_default`` entry.
    """
    default = F.coalesce(F.try_element_at(baseline, F.lit("_default")), F.lit(0.15))
    best = F.array_max(F.transform(cuisines, lambda c: F.try_element_at(baseline, c)))
    base = F.greatest(default, F.coalesce(best, default))
    return F.least(F.lit(cv.MAX_RISK), boost_at_home(base, cuisines, region, 0.25))


# --- Quality ----------------------------------------------------------------------
def quality_summary(places: DataFrame) -> DataFrame:
    """One pass: totals, per-field presence and the mean score."""
    counts = [F.count_if(F.coalesce(_present(f), F.lit(False))).alias(f"with_{f}") for f in pv.QUALITY_FIELDS]
    return places.agg(F.count("*").alias("total_rows"), F.round(F.avg("data_quality_score"), 3).alias("average_score"), *counts)


def _present(field: str) -> Column:
    return has_value(F.col(field), QUALITY_KINDS[field])


def source_counts(places: DataFrame) -> DataFrame:
    return places.groupBy("source_name").agg(F.count("*").alias("n_rows"))


def source_coverage(groups: DataFrame, expected: list[str]) -> DataFrame:
    """How matched groups spread over the expected providers.

    ``groups`` holds group_id, source_name; one output row per provider plus
    the overall counts repeated on each.
    """
    sets = groups.groupBy("group_id").agg(F.collect_set("source_name").alias("sources"))
    wanted = text_array(sorted(expected))
    marked = sets.withColumn("_all", F.size(F.array_except(wanted, "sources")) == 0)

    def only(source: str) -> Column:
        return F.count_if(~F.col("_all") & (F.size("sources") == 1) & F.array_contains("sources", source))

    def missing(source: str) -> Column:
        return F.count_if(~F.col("_all") & ~F.array_contains("sources", source))

    per_source = F.array(*[F.struct(F.lit(s).alias("source_name"), only(s).alias("only_here"), missing(s).alias("missing_here"))
                           for s in sorted(expected)])
    return marked.agg(F.count("*").alias("n_groups"), F.count_if("_all").alias("matched_in_all"), per_source.alias("p")).select(
        "n_groups", "matched_in_all", (F.col("n_groups") - F.col("matched_in_all")).alias("not_in_all"), F.inline("p"))


# --- Same place across providers ---------------------------------------------------
def _near_cells(latitude: Column, longitude: Column, reach_m: float, cell_m: float) -> Column:
    """Grid cells that may hold a point within ``reach_m``."""
    steps = math.ceil(reach_m / cell_m)
    row = geo.row_cell(latitude, cell_m)
    farthest = F.least(F.abs(latitude) + (reach_m + cell_m) / geo.METRES_PER_DEGREE, F.lit(89.9))
    span = F.lit(reach_m / geo.METRES_PER_DEGREE) / F.cos(F.radians(farthest)) * 1.001

    def columns(r: Column) -> Column:
        def shifted(shift: Column) -> Column:
            west, east = longitude + shift - span, longitude + shift + span
            inside = (east >= -180) & (west <= 180)
            return F.when(inside, F.transform(F.sequence(geo.column_cell(west, r, cell_m), geo.column_cell(east, r, cell_m)),
                                              lambda c: F.struct(r.alias("r"), c.alias("c"))))
        return F.flatten(F.array_compact(F.transform(F.array(F.lit(0.0), F.lit(360.0), F.lit(-360.0)), shifted)))

    return F.array_distinct(F.flatten(F.transform(F.sequence(row - steps, row + steps), columns)))


def _around(df: DataFrame, max_m: float, cell_m: float, *columns: str) -> DataFrame:
    """One row per grid cell (``r, c``) that may hold a point in reach of a row."""
    return df.select("_key", *columns, F.explode(_near_cells(F.col("latitude"), F.col("longitude"), max_m, cell_m)).alias("_n")).select(
        "_key", *columns, F.col("_n.r").alias("r"), F.col("_n.c").alias("c"))


def _fold_units(units: DataFrame, max_m: float, cell_m: float) -> DataFrame:
    """``ord, group_id`` of every spot of ``units (_unit, ord, latitude, longitude, r, c)``, each unit walked once in its order.

    The units of a partition follow each other sorted, so a task holds the first rows of one unit's groups and nothing else.
    """
    def distance(a: tuple[float, float], b: tuple[float, float]) -> float:
        lat1, lat2 = math.radians(a[0]), math.radians(b[0])
        h = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * pv.EARTH_RADIUS_M * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, firsts = None, {}
        for batch in batches:
            columns = batch.to_pydict()
            groups = []
            for key, order, lat, lon, r, c, near in zip(*(columns[n] for n in ("_unit", "ord", "latitude", "longitude", "r", "c", "_near")), strict=True):
                if key != unit:
                    unit, firsts = key, {}
                known = (firsts[cell] for cell in ((n["r"], n["c"]) for n in near) if cell in firsts)
                group = min((first for first, place in known if distance(place, (lat, lon)) <= max_m), default=order)
                if group == order:
                    firsts[r, c] = (order, (lat, lon))
                groups.append(group)
            yield pa.RecordBatch.from_pydict({"ord": batch.column("ord"), "group_id": pa.array(groups, pa.int64())})

    near = _near_cells(F.col("latitude"), F.col("longitude"), max_m, cell_m)
    placed = units.select("_unit", F.col("ord").cast("bigint").alias("ord"), "latitude", "longitude", "r", "c", near.alias("_near"))
    return placed.repartition("_unit").sortWithinPartitions("_unit", "ord").mapInArrow(walk, "ord bigint, group_id bigint")


def _fold_in_rounds(spots: DataFrame, max_m: float, cell_m: float) -> DataFrame:
    """``ord, group_id`` of spots that are too many for one task.

    A cell's earliest open point starts a group once no nearby cell holds an earlier open point; points it reaches close. Every
    round settles at least the earliest open point of each neighbourhood.
    """
    open_spots, starts, rounds = spots, None, 0

    def reached(points: DataFrame, firsts: DataFrame) -> DataFrame:
        looked = _around(firsts.select("_key", F.col("ord").alias("first_ord"), F.col("latitude").alias("first_lat"),
                                       F.col("longitude").alias("first_lon"), "latitude", "longitude"), max_m, cell_m, "first_ord", "first_lat", "first_lon")
        near = geo.haversine_m(F.col("latitude"), F.col("longitude"), F.col("first_lat"), F.col("first_lon")) <= max_m
        return points.join(looked, ["_key", "r", "c"]).where(near & (F.col("first_ord") <= F.col("ord")))

    while not open_spots.isEmpty():
        heads = open_spots.groupBy("_key", "r", "c").agg(F.min_by(F.struct("latitude", "longitude", "ord"), "ord").alias("h")).select(
            "_key", "r", "c", "h.*")
        earlier = heads.select("_key", F.col("ord").alias("_other"), "r", "c")
        waiting = _around(heads, max_m, cell_m, "ord").join(earlier, ["_key", "r", "c"]).where(F.col("_other") < F.col("ord")).select("ord").distinct()
        new = cut_lineage(heads.join(waiting, "ord", "left_anti"))
        starts = new if starts is None else starts.unionByName(new)
        closed = reached(open_spots, new).select("ord").distinct()
        open_spots = cut_lineage(open_spots.join(closed, "ord", "left_anti"))
        rounds += 1
    _log.info("match_entities: %d rounds for components of too many spots", rounds)
    return reached(spots, starts).groupBy("ord").agg(F.min("first_ord").alias("group_id"))


def match_entities(places: DataFrame, ordinal: str, max_m: float = 75.0, walked: int = 20_000) -> DataFrame:
    """Group rows of one place: same name key, within reach of the group's first row.

    Greedy by ``ordinal`` (unique integers): a row joins the earliest group whose first row is near, else starts one.

    * Rows at one exact position always share a group, so they collapse first.
    * Grid cells are so small that all their points are in reach of each other, hence at most one group starts in a cell and
      each point has a bounded number of cells to look at, however many rows share a name or a spot.
    * A name with at most ``walked`` spots is walked once in order. A name with more falls into connected components of its
      occupied cells, which cannot influence each other; those of at most ``walked`` spots are walked likewise.
    * Only a component of more spots is settled in rounds, so that it never gathers in one task.

    Adds ``group_id``: the first row's ordinal. Rows without a name or valid coordinates stay alone.
    """
    cell_m = max_m / math.sqrt(2) * 0.999
    keyed = places.withColumn("_key", norm_key(F.col("name")))
    placed = (F.length("_key") > 0) & geo.valid_coordinates(F.col("latitude"), F.col("longitude"))
    spots = keyed.where(placed).groupBy("_key", "latitude", "longitude").agg(F.min(ordinal).alias("ord"))
    row = geo.row_cell(F.col("latitude"), cell_m)
    spots = cut_lineage(spots.withColumn("r", row).withColumn("c", geo.column_cell(F.col("longitude"), F.col("r"), cell_m)))
    crowded = spots.groupBy("_key").count().where(F.col("count") > walked).select("_key")
    few = spots.join(crowded, "_key", "left_anti").withColumn("_unit", F.col("_key"))
    homes = [_fold_units(few, max_m, cell_m)]
    many = cut_lineage(spots.join(crowded, "_key", "left_semi"))
    if not many.isEmpty():
        # A cell goes by its earliest spot.
        cells = many.groupBy("_key", "r", "c").agg(F.min_by(F.struct("latitude", "longitude"), "ord").alias("p"), F.min("ord").alias("cell"))
        reach = max_m + 2 * cell_m  # from any point of a cell to any cell that another point of it can reach
        edges = _around(cells.select("_key", "p.*", "cell"), reach, cell_m, "cell").join(cells.select("_key", "r", "c", F.col("cell").alias("b")), ["_key", "r", "c"])
        labels = components(edges.select(F.col("cell").alias("a"), "b"))
        labelled = cut_lineage(many.join(cells.select("_key", "r", "c", "cell"), ["_key", "r", "c"]).join(labels, F.col("cell") == F.col("node"), "left").withColumn(
            "_label", F.coalesce("label", "cell")).drop("cell", "node", "label"))
        large = labelled.groupBy("_label").count().where(F.col("count") > walked).select("_label")
        units = labelled.join(large, "_label", "left_anti").withColumn("_unit", F.col("_label").cast("string"))
        homes.append(_fold_units(units, max_m, cell_m))
        rest = cut_lineage(labelled.join(large, "_label", "left_semi").select(*spots.columns))
        if not rest.isEmpty():
            homes.append(_fold_in_rounds(rest, max_m, cell_m))
    found = spots.select("_key", "latitude", "longitude", "ord").join(reduce(DataFrame.unionByName, homes), "ord").drop("ord")
    joined = keyed.join(found, ["_key", "latitude", "longitude"], "left")
    return joined.withColumn("group_id", F.coalesce("group_id", F.col(ordinal))).drop("_key").select(*places.columns, "group_id")


# --- Nearby -------------------------------------------------------------------------
def within_radius(latitude: Column, longitude: Column, origin: tuple[float, float], radius_m: float) -> Column:
    """Circle test behind a box test that a columnar scan can prune by."""
    lat0, lon0 = origin
    dlat = radius_m / geo.METRES_PER_DEGREE
    dlon = dlat / max(math.cos(math.radians(min(abs(lat0) + dlat, 89.9))), 1e-3)
    box = latitude.between(lat0 - dlat, lat0 + dlat) & longitude.between(lon0 - dlon, lon0 + dlon)
    return box & (geo.haversine_m(latitude, longitude, F.lit(lat0), F.lit(lon0)) <= radius_m)


#: Places of one block of a grid cell, and pairs that one task compares.
_BLOCK_PLACES, _TASK_PAIRS = 256, 4_000_000


def nearby(origins: DataFrame, places: DataFrame, radius_m: float) -> DataFrame:
    """Places within reach of each origin, by grid-cell equi-join.

    ``origins`` holds origin_id, latitude, longitude. The places of a cell are cut into blocks, and the blocks dealt out to as many
    tasks as there are pairs to compare: neither few files nor a crowded cell leave the work to a few tasks.
    """
    cell_m = radius_m / 2
    looked = origins.select("origin_id", F.col("latitude").alias("_olat"), F.col("longitude").alias("_olon"),
                            F.explode(_near_cells(F.col("latitude"), F.col("longitude"), radius_m, cell_m)).alias("_n"))
    looked = looked.select("origin_id", "_olat", "_olon", F.col("_n.r").alias("_r"), F.col("_n.c").alias("_c"))
    celled = places.withColumn("_r", geo.row_cell(F.col("latitude"), cell_m))
    celled = celled.withColumn("_c", geo.column_cell(F.col("longitude"), F.col("_r"), cell_m))
    cells = celled.groupBy("_r", "_c").agg(F.count("*").alias("_n")).withColumn("_blocks", F.ceil(F.col("_n") / _BLOCK_PLACES).cast("int"))
    pairs = looked.groupBy("_r", "_c").agg(F.count("*").alias("_m")).join(cells, ["_r", "_c"]).agg(F.sum(F.col("_m").cast("double") * F.col("_n"))).first()[0] or 0.0
    tasks = max(places.sparkSession.sparkContext.defaultParallelism, math.ceil(pairs / _TASK_PAIRS))
    counted = cells.select("_r", "_c", "_blocks")
    block = F.pmod(F.xxhash64(*places.columns), F.col("_blocks")).cast("int")
    left = celled.join(counted, ["_r", "_c"]).withColumn("_b", block).drop("_blocks").repartition(tasks, "_r", "_c", "_b")
    right = looked.join(counted, ["_r", "_c"]).withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks").repartition(tasks, "_r", "_c", "_b")
    distance = geo.haversine_m(F.col("_olat"), F.col("_olon"), F.col("latitude"), F.col("longitude"))
    # The box is a little wider than the circle: it only spares the others the distance.
    box = F.abs(F.col("latitude") - F.col("_olat")) <= radius_m / geo.METRES_PER_DEGREE * 1.001
    return (right.join(left.hint("shuffle_hash"), ["_r", "_c", "_b"]).where(box).withColumn("distance_m", distance).where(F.col("distance_m") <= radius_m)
            .drop("_r", "_c", "_b", "_olat", "_olon"))


def nearest(places: DataFrame, origin: tuple[float, float], k: int) -> DataFrame:
    """The k closest places to one point (a top-k, merged from partial top-ks)."""
    distance = geo.haversine_m(F.col("latitude"), F.col("longitude"), F.lit(origin[0]), F.lit(origin[1]))
    return places.withColumn("distance_m", distance).orderBy("distance_m", "restaurant_id").limit(k)


def deep_top_n(rows: DataFrame, keys: list[str], n: int = 12) -> DataFrame:
    """Flags the nearest n rows of every request for the deep treatment."""
    deep = keep_first(rows, keys, [F.asc_nulls_last("distance_m"), F.asc("restaurant_id")], n).select(*keys, "restaurant_id").withColumn(
        "deep", F.lit(True))
    return rows.join(deep, [*keys, "restaurant_id"], "left").withColumn("deep", F.coalesce("deep", F.lit(False)))


def geocode_best_place(results: DataFrame) -> DataFrame:
    """Populated or administrative place of most importance per query."""
    kind = F.lower(F.coalesce("type", F.lit("")))
    tier = F.when((F.lower("category") == "place") & kind.isin(pv.GEOCODE_PLACE_TYPES), 1).when(
        (F.lower("category") == "boundary") & (kind == "administrative"), 1).otherwise(0)
    return keep_first(results.withColumn("tier", tier), ["query_id"],
                      [F.desc("tier"), F.desc(F.coalesce("importance", F.lit(0.0))), F.asc("result_ord")])


# --- Registry and name lookups ---------------------------------------------------------
def lookup_registry(restaurants: DataFrame, registry: DataFrame) -> DataFrame:
    """First registry entry by domain, or by name inside the restaurant's name plus city.

    Both tests are equi-joins: on each domain suffix of the site, and on the
    anchors of the compact names. ``registry`` holds entry_ord, name, city, domain and flags.
    """
    reg = registry.select("entry_ord", F.lower(blank_to_empty(F.col("domain"))).alias("domain"),
                          entity_compact(F.col("name")).alias("entry_key"), F.lower(blank_to_empty(F.col("city"))).alias("city"))
    site = registrable_domain(netloc(F.col("website_url")))
    labels = F.split(site, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    by_domain = (restaurants.where(F.length(site) > 0).select("restaurant_id", F.explode(suffixes).alias("domain"))
                 .join(reg.where(F.length("domain") > 0), "domain").select("restaurant_id", "entry_ord"))
    key = entity_compact(F.col("name"))
    named = restaurants.where(F.length(key) > 0).select("restaurant_id", F.lower(blank_to_empty(F.col("address"))).alias("_addr"), key.alias("_key"))
    inside = match_table(named, "_key", reg.select(F.col("entry_key").alias("term")), ["restaurant_id", "_addr"])
    by_name = (inside.withColumnRenamed("term", "entry_key").join(reg.where(F.length("entry_key") > 0), "entry_key")
               .where((F.length("city") == 0) | F.col("_addr").contains(F.col("city"))).select("restaurant_id", "entry_ord"))
    first = by_domain.unionByName(by_name).groupBy("restaurant_id").agg(F.min("entry_ord").alias("entry_ord"))
    return restaurants.join(first, "restaurant_id", "left")


def registry_signals(matched: DataFrame, registry: DataFrame) -> DataFrame:
    """OR verified flags into handling signals; a signal is never lowered."""
    flags = registry.select("entry_ord", "nut_free", "allergy_dedicated")
    joined = matched.join(flags, "entry_ord", "left")
    return joined.withColumn("nut_free_claim", F.col("nut_free_claim") | F.coalesce("nut_free", F.lit(False))).withColumn(
        "allergy_disclaimer", F.col("allergy_disclaimer") | F.coalesce("allergy_dedicated", F.lit(False))).drop("nut_free", "allergy_dedicated")


def name_matches(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """Row/query pairs whose name keys contain one another, with a match tier.

    Tier 1 exact, 2 prefix, 3 containment. Containment joins on anchors, keys of
    any length. ``queries`` holds query_id, query; ``rows`` row_id, name.
    """
    left = rows.select("row_id", norm_key(F.col("name")).alias("_rk")).where(F.length("_rk") > 0)
    right = queries.select("query_id", norm_key(F.col("query")).alias("_qk")).where(F.length("_qk") > 0)
    query_in_row = match_table(left, "_rk", right.select(F.col("_qk").alias("term")), ["row_id", "_rk"]).withColumnRenamed("term", "_qk").join(right, "_qk")
    row_in_query = match_table(right, "_qk", left.select(F.col("_rk").alias("term")), ["query_id", "_qk"]).withColumnRenamed("term", "_rk").where(
        F.col("_rk") != F.col("_qk")).join(left, "_rk")
    pairs = query_in_row.select("row_id", "query_id", "_rk", "_qk").unionByName(
        row_in_query.select("row_id", "query_id", "_rk", "_qk"))
    tier = F.when(F.col("_rk") == F.col("_qk"), 1).when(
        F.col("_rk").startswith(F.col("_qk")) | F.col("_qk").startswith(F.col("_rk")), 2).otherwise(3)
    return pairs.select("row_id", "query_id", tier.alias("tier"))


def best_name_match(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """Per query the best-tier, then nearest row."""
    matched = name_matches(rows, queries).join(rows, "row_id")
    return keep_first(matched, ["query_id"], [F.asc("tier"), F.asc("distance_m"), F.asc("row_id")])


def name_candidates(rows: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """Per query the nearest n rows related by containment either way."""
    matched = name_matches(rows, queries).join(rows, "row_id")
    return keep_first(matched, ["query_id"], [F.asc("distance_m"), F.asc("row_id")], n, rank="position")


def official_domain(website: Column) -> Column:
    return host(website)
