"""Ranks over groups of any size.

A window over one hot group sorts it in one task. Here rows are cut into buckets
that follow the order, counts per bucket are summed up to offsets, and only a
bucket's own rows are numbered together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(rows: DataFrame, by: list[Column], bucket: Column, order: list[Column | str]) -> DataFrame:
    """``rows`` with _rank (from 1) and _total in their group; ``bucket`` must grow with ``order``."""
    keys = [f"_by{k}" for k in range(len(by))]
    staged = rows.select("*", *[c.alias(k) for c, k in zip(by, keys, strict=True)], bucket.alias("_bucket"))
    counts = staged.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*(keys or [F.lit(0)]))  # one row per bucket
    before = F.coalesce(F.sum("_n").over(group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*[F.col(k).alias(f"_o{k}") for k in keys], F.col("_bucket").alias("_ob"), before.alias("_before"), F.sum("_n").over(group).alias("_total"))
    own = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    same = F.col("_bucket").eqNullSafe(F.col("_ob"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_o{k}"))
    joined = staged.withColumn("_w", own).join(offsets, same)
    return joined.withColumn("_rank", F.col("_before") + F.col("_w")).drop(*keys, *[f"_o{k}" for k in keys], "_ob", "_bucket", "_before", "_w")
