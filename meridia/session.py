"""Session settings that the library's plans rely on, and scratch tables that cut lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "meridia", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, ANSI arithmetic and adaptive execution; partitions follow the data through AQE."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as ``spark.checkpoint.dir`` names it. Where it names none,
    a local session, whose executors are this machine, gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = os.path.join(tempfile.gettempdir(), "meridia-scratch")
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder path in the shared scratch; what is written there goes when the program ends."""
    path = f"{scratch_root(spark)}/meridia-{name}-{uuid.uuid4().hex[:12]}"
    context = spark.sparkContext

    def drop() -> None:
        try:
            target = context._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may be gone at exit; the folder is only scratch
            pass

    atexit.register(drop)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a table in the shared scratch: computed once, and not again for a lost executor."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
