"""Session settings and the shared checkpoint location."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on. Partition counts are left to adaptive execution:
# start wide, let it coalesce small shuffles and split skewed join partitions.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(app: str = "dinesight", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the library's settings; ``master`` only for local runs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = (builder.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
                   .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g"))
    for key, value in (SETTINGS | extra).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the running application, set where the session names none."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        configured = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if configured:
            context.setCheckpointDir(configured)
        elif context.master.startswith("local"):
            context.setCheckpointDir(tempfile.mkdtemp(prefix="dinesight-ckpt-"))
        else:
            raise ValueError("set spark.checkpoint.dir to a shared folder before running iterative jobs")
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the cluster names in spark.checkpoint.dir.

    Survives lost executors because the rows live in shared storage. A folder of
    our own is set only where the session names none (single-machine tests).
    """
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, so that joins with it are planned from the size it has."""
    path = f"{_shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
