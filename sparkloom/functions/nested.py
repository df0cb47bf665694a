"""Values of JSON at any depth, level after level.

A level is one lateral join with ``variant_explode``; what is an object or a list goes on
to the next, until a level has none. Each level is written, so that the work is that of
the values and no plan grows with the depth. Keys come in the order of their names, which
is how variants hold them, list items in their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import kept

LEVELS = 6  # levels of a text that are opened before it is written


def kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, VOID or the name of a number's type."""
    return F.regexp_extract(F.schema_of_variant(v), r"^[A-Z]+", 0)


def leaves(rows: DataFrame, content: str) -> DataFrame:
    """The rows' other columns with path, place, value (a variant) and kind of each value that is no object and no list.

    path has the keys from the outside in, list items as ``[k]`` from 0; place has their
    positions. Text that is no JSON, and null, have no values; a bare value has an empty path.
    """
    spark, rest = rows.sparkSession, [c for c in rows.columns if c != content]
    if clash := {"path", "place", "value", "kind", "_level"} & set(rest):
        raise ValueError(f"columns are taken: {sorted(clash)}")
    top = rows.select(*rest, F.array().cast("array<string>").alias("path"), F.array().cast("array<int>").alias("place"), F.try_parse_json(F.col(content).cast("string")).alias("value"))
    level = top.where("value IS NOT NULL").withColumn("kind", kind(F.col("value")))
    found, inner = [], F.col("kind").isin("OBJECT", "ARRAY")
    while True:
        found.append(level.where(~inner))
        outer = level.where(inner).withColumnRenamed("value", "_level")
        exploded = outer.lateralJoin(spark.tvf.variant_explode(F.col("_level").outer()))
        key = F.when(F.col("kind") == "ARRAY", F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.col("key"))
        level = kept(exploded.select(*rest, F.concat("path", F.array(key)).alias("path"), F.concat("place", F.array("pos")).alias("place"), F.col("value"), kind(F.col("value")).alias("kind")))
        if level.where(inner).isEmpty():
            return reduce(DataFrame.unionByName, [*found, level])


def text_of(value: Column, kind: Column) -> Column:
    """A value as text; null is ``none``."""
    return F.when(kind == "VOID", "none").otherwise(F.try_variant_get(value, "$", "string"))


def _inside(values: Column) -> Column:
    """An array of variants with each object and list replaced by what it holds, in place."""
    fields = lambda v: F.map_values(F.try_variant_get(v, "$", "map<string,variant>"))
    return F.flatten(F.transform(values, lambda v: F.coalesce(fields(v), F.try_variant_get(v, "$", "array<variant>"), F.array(v))))


def texts(rows: DataFrame, content: str) -> DataFrame:
    """The rows' other columns with text: all values of a row's JSON in order, parted by spaces; null without values.

    Nothing is shuffled: a row's values stay in it. ``LEVELS`` levels are opened at once
    and written; rows that go deeper do so again.
    """
    rest = [c for c in rows.columns if c != content]
    if clash := {"text", "_values"} & set(rest):
        raise ValueError(f"columns are taken: {sorted(clash)}")
    left = rows.select(*rest, F.filter(F.array(F.try_parse_json(F.col(content).cast("string"))), lambda v: v.isNotNull()).alias("_values"))
    found, v = [], F.col("_values")
    deep = F.exists(v, lambda x: F.schema_of_variant(x).rlike("^(OBJECT|ARRAY)"))
    text = F.when(F.size(v) > 0, F.array_join(F.transform(v, lambda x: F.when(F.is_variant_null(x), "none").otherwise(F.try_variant_get(x, "$", "string"))), " "))
    while True:
        opened = left.select(*rest, reduce(lambda x, _: _inside(x), range(LEVELS), v).alias("_values"))
        opened = kept(opened.select(*rest, F.when(deep, v).alias("_values"), F.when(~deep, text).alias("text")))
        found.append(opened.where("_values IS NULL").drop("_values"))
        left = opened.where("_values IS NOT NULL").drop("text")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, found)


def flattened(rows: DataFrame, key: str, content: str) -> DataFrame:
    """key and text: all values of a row's JSON in order, parted by spaces; rows without values have none.

    ``key`` tells rows apart.
    """
    return texts(rows.select(key, content), content).where("text IS NOT NULL")


def numbers(rows: DataFrame, content: str) -> DataFrame:
    """The rows' other columns with name, keys joined by ``_``, and value of every number."""
    found = leaves(rows, content).where(~F.col("kind").isin("STRING", "BOOLEAN", "VOID"))
    value = F.try_variant_get("value", "$", "double")
    return found.select(*[c for c in rows.columns if c != content], F.array_join(F.transform("path", lambda k: F.regexp_replace(k, r"^\[(\d+)\]$", "$1")), "_").alias("name"), value.alias("value"))


def performance(rows: DataFrame, content: str) -> DataFrame:
    """The rows' other columns with name and value of ``{suite: {"metrics": {metric: number or {"mean": number}}}}``, names as suite_metric."""
    found = leaves(rows, content).where(~F.col("kind").isin("STRING", "BOOLEAN", "VOID"))
    p, n = F.col("path"), F.size("path")
    own = (n.isin(3, 4)) & (F.try_element_at(p, F.lit(2)) == "metrics") & ((n == 3) | (F.try_element_at(p, F.lit(4)) == "mean"))
    return found.where(own).select(*[c for c in rows.columns if c != content], F.concat_ws("_", F.try_element_at(p, F.lit(1)), F.try_element_at(p, F.lit(3))).alias("name"), F.try_variant_get("value", "$", "double").alias("value"))
