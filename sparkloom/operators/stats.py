"""Statistics of extraction results; all are partial aggregations before one shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import ranked


def overall(results: DataFrame) -> DataFrame:
    """Counts, distinct jobs and chunks, confidence and times; one row even for none."""
    return results.agg(
        F.count("*").alias("total"), F.count_distinct("job_id").alias("jobs"), F.count_distinct("chunk_id").alias("chunks"), F.avg("confidence").alias("avg_confidence"),
        F.min("confidence").alias("min_confidence"), F.max("confidence").alias("max_confidence"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"),
    )


def by_category(results: DataFrame) -> DataFrame:
    """Count and mean confidence per category."""
    return results.select(F.explode("categories").alias("category"), "confidence").groupBy("category").agg(F.count("*").alias("n"), F.avg("confidence").alias("avg_confidence"))


def by_chunk(results: DataFrame) -> DataFrame:
    return results.groupBy("chunk_id").agg(F.count("*").alias("n"), F.avg("confidence").alias("avg_confidence"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"))


def by_time(results: DataFrame, unit: str = "day") -> DataFrame:
    """Count and mean confidence per hour, day or month, as text."""
    form = {"hour": "yyyy-MM-dd HH:00", "day": "yyyy-MM-dd", "month": "yyyy-MM"}[unit]
    return results.groupBy(F.date_format("created_at", form).alias("bucket")).agg(F.count("*").alias("n"), F.avg("confidence").alias("avg_confidence"))


def band(c: Column) -> Column:
    return F.when(c >= 0.9, "high").when(c >= 0.7, "medium").when(c >= 0.5, "low").otherwise("very_low")


def by_band(results: DataFrame) -> DataFrame:
    """Count and categories per result for each confidence band."""
    n = F.size("categories")
    return results.groupBy(band(F.col("confidence")).alias("band")).agg(F.count("*").alias("n"), F.avg(n).alias("avg_categories"), F.max(n).alias("max_categories"))


def storage(results: DataFrame, by: str) -> DataFrame:
    """Estimated bytes: lengths plus 100 a row."""
    return results.groupBy(by).agg(F.count("*").alias("n"), (F.coalesce(F.sum(F.length("extracted_data")), F.lit(0)) + F.count("*") * 100).alias("bytes"))


def partials(results: DataFrame) -> DataFrame:
    """Metadata per job and chunk: count, mean confidence, categories, first and last time."""
    cats = F.array_sort(F.array_distinct(F.flatten(F.collect_set("categories"))))
    return results.groupBy("job_id", "chunk_id").agg(F.count("*").alias("n"), F.avg("confidence").alias("avg_confidence"), cats.alias("categories"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"))


def merged(parts: DataFrame) -> DataFrame:
    """Job metadata from partial metadata: weighted mean, union of categories, time range."""
    cats = parts.select("job_id", F.explode_outer("categories").alias("c")).distinct().groupBy("job_id").agg(F.array_join(F.array_sort(F.collect_list("c")), ",").alias("categories"))
    sums = parts.groupBy("job_id").agg(F.sum("n").alias("n"), (F.sum(F.col("avg_confidence") * F.col("n")) / F.sum("n")).alias("avg_confidence"), F.min("oldest").alias("oldest"), F.max("newest").alias("newest"))
    return sums.join(cats, "job_id")


def time_chunks(results: DataFrame, rows: int = 100) -> DataFrame:
    """chunk_name, part, n and min_ts: hours of results in parts of ``rows``; ranks go by seconds, so that a busy hour is many tasks' work."""
    hour = F.date_format("created_at", "yyyyMMdd_HH")
    own = results.select(hour.alias("hour"), "created_at", "id")
    numbered = ranked(own, [F.col("hour")], F.unix_timestamp(F.col("created_at").cast("timestamp")), ["created_at", "id"]).withColumn("part", F.floor((F.col("_rank") - 1) / rows))
    return numbered.groupBy(F.col("hour").alias("chunk_name"), "part").agg(F.count("*").alias("n"), F.min("created_at").alias("min_ts"))


def size_chunks(results: DataFrame, by: str, rows: int = 100, width: int = 100_000) -> DataFrame:
    """chunk_name size_chunk_i per group, in id order, ``rows`` each; ranks go by ranges of ``width`` ids."""
    numbered = ranked(results.select(by, "id", "confidence"), [F.col(by)], F.floor(F.col("id") / width), ["id"]).withColumn("i", F.floor((F.col("_rank") - 1) / rows))
    return numbered.groupBy(by, F.concat(F.lit("size_chunk_"), F.col("i").cast("string")).alias("chunk_name")).agg(F.count("*").alias("n"), F.avg("confidence").alias("avg_confidence"), F.min("id").alias("first_id"))


def moving_average(events: DataFrame, by: str, order: list[str], value: str, alpha: float = 0.1) -> DataFrame:
    """The exponential moving average at the end of each group's ordered values.

    Weights depend on the rank from the end only, so it is a sum over ranks: no array
    is built. ``order`` begins with a time; ranks go by its hours.
    """
    bucket = F.floor(F.unix_timestamp(F.col(order[0]).cast("timestamp")) / 3600)
    rows = ranked(events.select(by, *order, F.col(value).alias("_v")), [F.col(by)], bucket, list(order))
    last = F.col("_total") - F.col("_rank")
    weight = F.pow(F.lit(1 - alpha), last) * F.when(F.col("_rank") == 1, 1.0).otherwise(alpha)
    return rows.groupBy(by).agg(F.sum(F.col("_v") * weight).alias("ema"))


def operation_metrics(ops: DataFrame, op: str, value: str, failed: Column) -> DataFrame:
    """Count, errors, latency and a health status per kind of operation."""
    out = ops.groupBy(F.col(op).alias("op")).agg(F.count("*").alias("n"), F.count_if(failed).alias("errors"), F.max(value).alias("max_value"), F.min(value).alias("min_value"), F.avg(value).alias("avg_value"))
    rate = F.col("errors") / F.col("n")
    return out.withColumn("health", F.when(rate > 0.1, "critical").when(rate > 0.05, "warning").otherwise("healthy"))
