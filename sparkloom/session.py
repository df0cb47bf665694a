"""Session helpers: table loading and a local session for tests and benches."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def local_session(cores: int | None = None, memory: str = "8g", name: str = "sparkloom") -> SparkSession:
    """A local session with the settings the tests and the bench rely on."""
    cores = cores or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``, a file or a folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def placed(df: DataFrame) -> DataFrame:
    """``df``, as read from Parquet files, with ``place``: its rows in the order in which they lie there."""
    return df.withColumn("place", F.struct("_metadata.file_path", "_metadata.row_index"))


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Register the named tables as temporary views."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def scratch(spark: SparkSession, what: str = "scratch") -> str:
    """A new folder below ``spark.checkpoint.dir``; in local sessions without that setting a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = tempfile.mkdtemp(prefix="sparkloom-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        root = f"file://{root}"
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """``df`` written once and read again: its lineage ends there."""
    path = scratch(df.sparkSession, "kept")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
