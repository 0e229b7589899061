"""Provider dumps -> one restaurant schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dinesight.functions import geo
from dinesight.functions.literals import text_array
from dinesight.functions.text import has_value, quality_score
from dinesight.operators.entities import QUALITY_KINDS
from dinesight.schemas import GEOAPIFY_DUMP, GOOGLE_DUMP, OSM_DUMP
from dinesight.vocab import places as pv


def union_providers(*providers: DataFrame) -> DataFrame:
    """All provider rows; columns a provider lacks become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), providers)


def _first_value(*candidates: Column) -> Column:
    return F.coalesce(*[F.when(has_value(c), F.trim(c)) for c in candidates])


def _finish(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    rows = df.select(*[c.alias(name) for name, c in columns.items()])
    return rows.withColumn("data_quality_score", quality_score(QUALITY_KINDS))


def _distance(origin: tuple[float, float] | None, latitude: Column, longitude: Column) -> Column:
    if origin is None:
        return F.lit(None).cast("double")
    return F.round(geo.haversine_m(F.lit(origin[0]), F.lit(origin[1]), latitude, longitude), 1)


def _documents(spark: SparkSession, path: str) -> DataFrame:
    """Dumps as (file_path, body)."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("body"))


def _records(docs: DataFrame, field: str, schema: str) -> DataFrame:
    """``file_path, ord, raw, e, fetched_at``: the records of every dump (file_path, body), as text and parsed each by itself.

    A record with one odd field does not cost the others theirs. A dump that cannot be read, or has no list of records, is one row
    without text; an empty list gives none.
    """
    element = T.StructType.fromDDL(schema)[field].dataType.elementType
    opened = docs.select("file_path", F.from_json("body", f"{field} ARRAY<STRING>, fetched_at STRING").alias("d"))
    listed = opened.where(F.col("d")[field].isNull() | (F.size(F.col("d")[field]) > 0)).select(
        "file_path", F.col("d.fetched_at").alias("fetched_at"), F.posexplode_outer(F.col("d")[field]).alias("ord", "raw"))
    return listed.withColumn("e", F.from_json("raw", element))


def _unreadable(records: DataFrame, latitude: Column, longitude: Column) -> DataFrame:
    """``file_path, ord, reason`` of dumps and records that give no row."""
    reason = F.when(F.col("raw").isNull(), "unreadable dump").when(~F.ltrim("raw").startswith("{"), "not an object").when(
        latitude.isNull() | longitude.isNull(), "no coordinates")
    return records.select("file_path", "ord", reason.alias("reason")).where("reason IS NOT NULL")


def read_places_osm(spark: SparkSession, path: str, origin: tuple[float, float]) -> DataFrame:
    """Overpass JSON dumps: one row per element with coordinates."""
    return places_from_osm(_documents(spark, path), origin)[0]


def places_from_osm(docs: DataFrame, origin: tuple[float, float]) -> tuple[DataFrame, DataFrame]:
    """(rows, unreadable records) of Overpass dumps given as (file_path, body)."""
    elements = _records(docs, "elements", OSM_DUMP)
    tags = F.col("e.tags")

    def tag(name: str) -> Column:
        return F.when(F.length(F.try_element_at(tags, F.lit(name))) > 0, F.try_element_at(tags, F.lit(name)))

    own = F.col("e.lat").isNotNull() & F.col("e.lon").isNotNull()
    latitude = F.when(own, F.col("e.lat")).otherwise(F.col("e.center.lat"))
    longitude = F.when(own, F.col("e.lon")).otherwise(F.col("e.center.lon"))
    street = F.concat_ws(" ", tag("addr:housenumber"), tag("addr:street"))
    town = F.concat_ws(", ", tag("addr:city"), tag("addr:state"))
    address = F.concat_ws(", ", *[F.when(F.length(p) > 0, p) for p in (street, town, tag("addr:postcode"))])
    categories = F.array_compact(F.array(*[F.concat(F.lit(f"{k}:"), tag(k))
                                           for k in ("amenity", "cuisine", "diet:vegan", "diet:vegetarian")]))
    closed = tag("disused:amenity").isNotNull() | tag("abandoned:amenity").isNotNull()
    rows = _finish(elements.where(latitude.isNotNull() & longitude.isNotNull()), {
        "name": F.try_element_at(tags, F.lit("name")), "address": F.when(F.length(address) > 0, address),
        "latitude": latitude, "longitude": longitude, "distance_meters": _distance(origin, latitude, longitude),
        "rating": F.lit(None).cast("double"), "review_count": F.lit(None).cast("int"), "price_level": F.lit(None).cast("string"),
        "categories": categories, "website_url": F.coalesce(tag("website"), tag("contact:website")),
        "phone_number": F.coalesce(tag("phone"), tag("contact:phone")), "opening_hours": F.try_element_at(tags, F.lit("opening_hours")),
        "business_status": F.when(closed, "closed_or_inactive").when(tag("amenity").isin(pv.FOOD_AMENITIES), "presumed_operational"),
        "is_open_now": F.lit(None).cast("boolean"), "service_options": F.expr("CAST(map() AS MAP<STRING, BOOLEAN>)"),
        "source_last_updated": F.coalesce(tag("check_date"), tag("check_date:opening_hours"), tag("survey:date"), tag("opening_hours:signed")),
        "source_name": F.lit("openstreetmap"), "source_id": F.concat_ws("/", F.col("e.type"), F.col("e.id").cast("string")),
        "fetched_at": F.col("fetched_at"), "raw_payload": F.col("raw")})
    return rows, _unreadable(elements, latitude, longitude)


def read_places_geoapify(spark: SparkSession, path: str) -> DataFrame:
    """GeoJSON features: first non-blank of several property paths."""
    return places_from_geoapify(_documents(spark, path))[0]


def places_from_geoapify(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, unreadable records) of GeoJSON dumps given as (file_path, body)."""
    features = _records(docs, "features", GEOAPIFY_DUMP)
    p, raw = F.col("e.properties"), F.col("e.properties.datasource.raw")
    point = F.col("e.geometry.coordinates")

    def from_raw(name: str) -> Column:
        return F.try_element_at(raw, F.lit(name))

    options = [("takeaway", "takeout"), ("delivery", "delivery"), ("outdoor_seating", "outdoorSeating"),
               ("indoor_seating", "indoorSeating"), ("diet:vegetarian", "servesVegetarianFood"), ("diet:vegan", "servesVeganFood")]
    flags = F.map_from_entries(F.array_compact(F.array(*[
        F.when(from_raw(key).isin("yes", "no"), F.struct(F.lit(name).alias("key"), (from_raw(key) == "yes").alias("value")))
        for key, name in options])))
    closed = has_value(from_raw("disused:amenity")) | has_value(from_raw("abandoned:amenity"))
    osm_id = F.concat_ws("/", from_raw("osm_type"), from_raw("osm_id"))
    latitude, longitude = F.get(point, F.lit(1)), F.get(point, F.lit(0))
    rows = _finish(features.where(F.size(point) >= 2), {
        "name": p["name"], "address": p["formatted"], "latitude": latitude, "longitude": longitude,
        "distance_meters": F.round(F.coalesce(p["distance"], F.lit(0.0)), 1),
        "rating": F.lit(None).cast("double"), "review_count": F.lit(None).cast("int"), "price_level": F.lit(None).cast("string"),
        "categories": F.coalesce(p["categories"], text_array([])),
        "website_url": _first_value(p["website"], p["contact"]["website"], from_raw("website")),
        "phone_number": _first_value(p["phone"], p["contact"]["phone"], from_raw("phone")),
        "opening_hours": _first_value(p["opening_hours"], from_raw("opening_hours")),
        "business_status": F.when(closed, "closed_or_inactive").when(F.size(p["categories"]) > 0, "presumed_operational"),
        "is_open_now": F.lit(None).cast("boolean"), "service_options": flags,
        "source_last_updated": _first_value(from_raw("check_date"), from_raw("check_date:opening_hours"), from_raw("survey:date")),
        "source_name": F.lit("geoapify"),
        "source_id": F.coalesce(F.when(has_value(p["place_id"]), p["place_id"]), F.when(has_value(from_raw("osm_id")), osm_id), F.lit("")),
        "fetched_at": F.col("fetched_at"), "raw_payload": F.col("raw")})
    return rows, _unreadable(features, latitude, longitude)


_GOOGLE_FLAGS = ("servesBreakfast servesLunch servesDinner servesBrunch servesVegetarianFood servesBeer servesWine servesCocktails "
                 "servesDessert servesCoffee menuForChildren takeout delivery dineIn curbsidePickup reservable").split()


def read_places_google(spark: SparkSession, path: str, origin: tuple[float, float] | None = None) -> DataFrame:
    """Places dumps: typed categories, joined hours, present-only services."""
    return places_from_google(_documents(spark, path), origin)[0]


def places_from_google(docs: DataFrame, origin: tuple[float, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, unreadable records) of Places dumps given as (file_path, body)."""
    places = _records(docs, "places", GOOGLE_DUMP)
    g = F.col("e")
    latitude, longitude = g["location"]["latitude"], g["location"]["longitude"]
    current, regular = g["currentOpeningHours"], g["regularOpeningHours"]

    def hours(h: Column) -> Column:
        return F.when(F.size(h["weekdayDescriptions"]) > 0, F.array_join(h["weekdayDescriptions"], "; "))

    services = F.map_from_entries(F.array_compact(F.array(*[
        F.when(g[name].isNotNull(), F.struct(F.lit(name).alias("key"), g[name].alias("value"))) for name in _GOOGLE_FLAGS])))
    categories = F.concat(F.array_compact(F.array(F.when(has_value(g["primaryType"]), F.concat(F.lit("primary_type:"), g["primaryType"])))),
                          F.coalesce(g["types"], text_array([])))
    rows = _finish(places.where(latitude.isNotNull() & longitude.isNotNull()), {
        "name": g["displayName"]["text"], "address": g["formattedAddress"], "latitude": latitude, "longitude": longitude,
        "distance_meters": _distance(origin, latitude, longitude), "rating": g["rating"], "review_count": g["userRatingCount"],
        "price_level": g["priceLevel"], "categories": categories, "website_url": g["websiteUri"],
        "phone_number": _first_value(g["nationalPhoneNumber"], g["internationalPhoneNumber"]),
        "opening_hours": F.coalesce(hours(current), hours(regular)), "business_status": g["businessStatus"],
        "is_open_now": F.coalesce(current["openNow"], regular["openNow"]), "service_options": services,
        "source_last_updated": F.lit(None).cast("string"), "source_name": F.lit("google_places"),
        "source_id": F.coalesce(g["id"], F.lit("")), "fetched_at": F.col("fetched_at"), "raw_payload": F.col("raw")})
    return rows, _unreadable(places, latitude, longitude)
