"""SparkSession factory with the settings that the operators assume."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, app: str = "hexcast", **conf: str) -> SparkSession:
    """UTC, ANSI and adaptive execution; conf overrides, with dots written as two underscores."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is set, a local one for a local master only."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = f"file://{tempfile.gettempdir()}/hexcast"
    return shared.rstrip("/")


def materialised(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: later steps see the same rows, whatever is lost."""
    path = f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df dealt out over the session's cores, for few or small rows that each make much work: a small file is one task otherwise."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))
