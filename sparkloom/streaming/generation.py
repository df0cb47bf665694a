"""Dataset generation that can be stopped and goes on where it was.

Chunks are a stream of files, a few a batch. Each batch's entries are written to a folder
named by the batch's number, which a repeated batch overwrites, and the checkpoint says
which batches are done: no chunk is lost and none comes twice, wherever a run ends.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import replies as P
from ..operators import models as M

Generator = Callable[[DataFrame], DataFrame]


def qa_generator(model: M.Model, prompt: Column, per_chunk: int = 3) -> Generator:
    """Entries of a model's replies, at most ``per_chunk`` a chunk; a reply is a JSON list or one entry."""

    def generate(chunks: DataFrame) -> DataFrame:
        asked = M.apply(chunks, prompt, model)
        parts = F.coalesce(F.from_json("reply", "array<string>"), F.array("reply"))
        each = asked.select(*chunks.columns, F.posexplode(F.slice(parts, 1, per_chunk)).alias("entry_index", "_part"))
        return each.select(*chunks.columns, "entry_index", P.entry(F.col("_part")).alias("_e")).select(*chunks.columns, "entry_index", "_e.*")

    return generate


def generate(spark: SparkSession, chunks: str, out: str, generator: Generator, files_per_batch: int = 1, seconds: float | None = None) -> DataFrame:
    """Entries of all chunk files (Parquet) at ``chunks``, made into ``out``; a second call goes on after the last whole batch.

    After ``seconds`` the run stops between batches; what is there is returned.
    """
    stream = spark.readStream.schema(spark.read.parquet(chunks).schema).option("maxFilesPerTrigger", files_per_batch).parquet(chunks)

    def write(batch: DataFrame, number: int) -> None:
        generator(batch).write.mode("overwrite").parquet(f"{out}/entries/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    try:
        query.awaitTermination(seconds)
    finally:
        query.stop()
    return entries(spark, out)


def entries(spark: SparkSession, out: str) -> DataFrame:
    """What has been generated so far, with the batch it came in."""
    return spark.read.option("basePath", f"{out}/entries").parquet(f"{out}/entries/batch=*")


def progress(spark: SparkSession, chunks: str, out: str) -> DataFrame:
    """processed and total chunks, and their share."""
    done = entries(spark, out).select("chunk_id").distinct().agg(F.count("*").alias("processed"))
    total = spark.read.parquet(chunks).agg(F.count("*").alias("total"))
    return done.crossJoin(total).withColumn("share", F.when(F.col("total") > 0, F.col("processed") / F.col("total")).otherwise(1.0))  # one row each
