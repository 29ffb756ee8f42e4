"""Session settings, table access and lineage cutting shared by all operators."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build(app: str = "quillstone", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and Arrow transfer; `conf` overrides."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    return b.config(map=settings).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory; columns are pruned by what the caller selects."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder: the shared one the cluster names, or a temporary one if none is named (tests)."""
    sc = spark.sparkContext
    now = sc.getCheckpointDir()
    if now:
        return now
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = Path(tempfile.mkdtemp(prefix="quillstone-checkpoint-")).as_uri()
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder and go on from the files, so that lineage stays short
    and the loss of an executor costs no recomputation of earlier rounds."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Give up shuffle and checkpoint files that no table needs any more: Spark drops them when the driver collects its garbage,
    which it does by itself only if its memory runs short, not the disk."""
    spark.sparkContext._jvm.System.gc()


def width(spark: SparkSession) -> int:
    """Number of shuffle partitions in force."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
