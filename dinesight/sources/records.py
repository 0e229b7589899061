"""Record files: lenient CSV, exports, fixtures, run logs, caches, knowledge bases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dinesight.functions.text import clean_text
from dinesight.functions.urls import is_http_url
from dinesight.operators.evaluation import validate_required
from dinesight.schemas import MENU_ITEM, MENU_SOURCE, MENU_TEXT, RUN_RESULT


# --- CSV ----------------------------------------------------------------------------
def lenient(c: Column, data_type: T.DataType) -> Column:
    """Text to a type, null when it does not parse; lists split on semicolons."""
    if isinstance(data_type, T.ArrayType):
        return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda t: F.trim(t)), lambda t: F.length(t) > 0)
    text = F.trim(c)
    if isinstance(data_type, T.MapType):
        return F.from_json(F.when(F.length(text) > 0, text), data_type.simpleString())
    if isinstance(data_type, (T.IntegerType, T.LongType)):
        return text.try_cast("double").try_cast(data_type)
    return c if isinstance(data_type, T.StringType) else text.try_cast(data_type)


def with_schema(df: DataFrame, schema: str) -> DataFrame:
    """All-text columns cast leniently to a schema; absent columns become null."""
    fields = T.StructType.fromDDL(schema).fields
    present = set(df.columns)
    return df.select(*[(lenient(F.col(f.name), f.dataType) if f.name in present else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields])


def read_records_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header (and byte-order mark), every field read as text first."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(path)
    renamed = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    return with_schema(renamed, schema)


def _flat(df: DataFrame, columns: list[str]) -> DataFrame:
    """Lists joined by '; ', maps as JSON with sorted keys, structs as JSON."""
    def cell(name: str) -> Column:
        kind = df.schema[name].dataType
        if isinstance(kind, T.ArrayType):
            return F.array_join(F.col(name).cast("array<string>"), "; ")
        if isinstance(kind, T.MapType):
            return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(name))))
        return F.to_json(name) if isinstance(kind, T.StructType) else F.col(name).cast("string")

    return df.select(*[cell(c).alias(c) for c in columns])


def run_path(base: str, prefix: str, label: str, stamp: str) -> str:
    """Folder of one labelled run: prefix_label_stamp."""
    import re
    slug = re.sub(r"[^a-z0-9]+", "_", label.strip().lower()).strip("_") or "item"
    return f"{base}/{prefix}_{slug}_{stamp}"


def write_records_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """The listed columns only; other columns are ignored."""
    _flat(df, columns).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_records_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


# --- JSON documents -------------------------------------------------------------------
def _documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as (file_path, body)."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("body"))


def _stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)\.json$", 1)


def load_keyed_cache_dir(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """<namespace>/<key>.json files -> (entries, rejected files).

    Entries: namespace, key, payload (JSON text), at. Loading twice gives the
    same rows; unreadable files and files that hold no object are rejected.
    """
    docs = _documents(spark, f"{folder}/*/*.json")
    marked = docs.withColumn("_ok", F.try_parse_json("body").isNotNull() & F.ltrim("body").startswith("{"))
    entries = marked.where("_ok").select(
        F.regexp_extract("file_path", r"([^/]+)/[^/]+$", 1).alias("namespace"), _stem(F.col("file_path")).alias("key"), F.col("body").alias("payload"),
        F.timestamp_seconds(F.get_json_object("body", "$.at").try_cast("double")).alias("at"))
    return entries, marked.where(~F.col("_ok")).select("file_path")


def read_fixture_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Menu documents -> menu_sources, menu_text, menu_items and their rejects."""
    def struct(schema: str) -> str:
        return f"STRUCT<{T.StructType.fromDDL(schema).simpleString()[7:-1]}>"

    parts = {"menu_sources": ("menuSources", MENU_SOURCE), "menu_text": ("menuText", MENU_TEXT), "menu_items": ("menuItems", MENU_ITEM)}
    schema = ", ".join(f"{field} ARRAY<{struct(ddl)}>" for field, ddl in parts.values()) + ", scenario STRING"
    docs = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file_path", F.col("_metadata.file_path"))
    good, rejected = validate_required(docs, ["scenario", "menuSources", "menuText", "menuItems"])
    tables = {name: good.select("scenario", F.explode(field).alias("r")).select("scenario", "r.*") for name, (field, _) in parts.items()}
    return tables | {"rejects": rejected.select("file_path", "missing")}


def read_run_results(spark: SparkSession, path: str) -> DataFrame:
    """One JSON row per evaluated chain, with nested maps and coverage."""
    return spark.read.schema(RUN_RESULT).json(path)


def run_coverage(runs: DataFrame) -> DataFrame:
    """One row per source a run read."""
    return runs.select("chain", F.posexplode("coverage").alias("source_ord", "c")).select("chain", "source_ord", "c.*")


def load_dish_kb(spark: SparkSession, folder: str) -> DataFrame:
    """[pattern, risk, note] files -> one table; the file name is the allergen."""
    docs = _documents(spark, f"{folder}/*.json").withColumn("rows", F.from_json("body", "array<array<string>>"))
    long = docs.select(_stem(F.col("file_path")).alias("allergen"), F.posexplode("rows").alias("ord", "r")).where(F.size("r") == 3)
    return long.select("allergen", F.lower(F.get("r", F.lit(0))).alias("pattern"), F.get("r", F.lit(1)).try_cast("double").alias("risk"),
                       F.get("r", F.lit(2)).alias("note"), "ord").where("risk IS NOT NULL")


def read_search_results(spark: SparkSession, path: str) -> DataFrame:
    """Stored web-search responses -> one row per HTTP hit."""
    schema = "query STRING, web STRUCT<results: ARRAY<STRUCT<title: STRING, url: STRING, description: STRING, extra_snippets: ARRAY<STRING>>>>"
    hits = spark.read.schema(schema).option("multiLine", True).json(path).select("query", F.posexplode("web.results").alias("result_ord", "h"))
    url = F.trim("h.url")
    snippets = F.filter(F.transform(F.coalesce("h.extra_snippets", F.array().cast("array<string>")), lambda s: F.trim(s)), lambda s: F.length(s) > 0)
    return hits.where(is_http_url(url)).select("query", "result_ord", url.alias("url"), clean_text(F.col("h.title")).alias("title"),
                                               F.trim(F.coalesce("h.description", F.lit(""))).alias("description"), snippets.alias("extra_snippets"))
