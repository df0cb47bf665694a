"""Helpers that the operators of this subpackage have in common."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which the cluster's machines share.

    Where that setting is missing a temporary folder stands in, in local sessions only.
    """
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        if not _FALLBACK:
            _FALLBACK.append(tempfile.mkdtemp(prefix="sparkloom-"))
            atexit.register(_drop, _FALLBACK[0])
        root = f"file://{_FALLBACK[0]}"
    return f"{root.rstrip('/')}/sparkloom-{uuid.uuid4().hex}"


def _drop(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read again.

    It cuts the lineage as ``checkpoint()`` does, but runs the plan once only.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(column: str, m: int) -> Column:
    """crc32 of the id as text, modulo ``m``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % m


def packed(docs: DataFrame, *columns: str) -> DataFrame:
    """The whole row as struct ``row`` beside some of its columns, so that no other name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *columns)


def unpacked(rows: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns of packed rows again, some replaced."""
    return rows.select(*[(new[c] if c in new else F.col("row")[c]).alias(c) for c in columns])


def with_text(rows: DataFrame, docs: DataFrame, changed: Column, text: Column) -> DataFrame:
    """Packed rows with another text where ``changed``; n_chars, if there, follows."""
    new = {"text": F.when(changed, text).otherwise(F.col("row")["text"])}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row")["n_chars"])
    return unpacked(rows, docs.columns, **new)
