"""Shared storage and small DataFrame helpers of the text operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a single-machine session that names none gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="dinesight-llm-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python in batches of bounded size, so that a worker's memory does not depend on their lengths."""
    for name, most in (("maxRecordsPerBatch", 2_000), ("maxBytesPerBatch", 16 << 20)):
        key = f"spark.sql.execution.arrow.{name}"
        given = spark.conf.get(key, None)
        if given is None or not given.isdigit() or not 0 < int(given) <= most:
            spark.conf.set(key, str(most))


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: an executor lost later costs only the tasks that read the
    table, never the work that made it.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame) -> DataFrame:
    """``written``, with batches of bounded size for the Python workers that read it."""
    small_batches(df.sparkSession)
    return written(df)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sampled_labels(labels: DataFrame, label: str, rows: int, value: int | None = None, learnable_only: bool = True) -> DataFrame:
    """At most ``rows`` labelled ids, chosen by a hash of the id.

    Null ids and labels take no part; an id labelled twice keeps its larger label.
    """
    kept = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    if learnable_only:
        kept = kept.where(~held_out(F.col("doc_id")))
    if value is not None:
        kept = kept.where(F.col(label) == value)
    ids = kept.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
