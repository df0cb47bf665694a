"""Writers and exports. Spark commits whole folders, so no lock or rollback is needed."""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FORMATTERS: dict[str, Callable[[DataFrame, str], None]] = {}


def register_formatter(name: str, write: Callable[[DataFrame, str], None]) -> None:
    FORMATTERS[name] = write


def json_line(df: DataFrame) -> Column:
    """A row as JSON."""
    return F.to_json(F.struct(*df.columns))


def write_dataset(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Rows as parquet, jsonl (or json, a line each), csv with a header, or a registered format."""
    if form in FORMATTERS:
        FORMATTERS[form](df, path)
    elif form == "parquet":
        df.write.parquet(path)
    elif form in ("json", "jsonl", "raw_list"):
        df.select(json_line(df).alias("value")).write.text(path)
    elif form == "csv":
        flat(df).write.option("header", "true").option("escape", '"').csv(path)
    else:
        raise ValueError(f"unknown format {form}")


def flat(df: DataFrame) -> DataFrame:
    """Arrays joined by commas and structs as JSON, for formats without nesting."""

    def one(name: str, kind: str) -> Column:
        if kind.startswith("array<string"):
            return F.concat_ws(", ", name).alias(name)
        return F.to_json(name).alias(name) if kind.startswith(("array", "struct", "map")) else F.col(name)

    return df.select(*[one(n, t) for n, t in df.dtypes])


def write_bundle(rows: DataFrame, path: str) -> None:
    """Rows by split, and by fold and difficulty where they have them."""
    keys = [c for c in ("split", "fold", "difficulty") if c in rows.columns]
    rows.write.partitionBy(*keys).parquet(path)


def write_texts(rows: DataFrame, path: str) -> int:
    """A text file for each row, at its ``name`` below ``path``: its ``value`` and a line feed. Returns how many.

    Tasks write them; Spark's own writer would have a folder a file, moved one by one at the end.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9+]+:/", path) else (fs.LocalFileSystem(), path)
        made = set()
        for b in batches:
            for name, value in zip(b["name"], b["value"], strict=True):
                file = posixpath.join(root, name)
                if (folder := posixpath.dirname(file)) not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(file) as out:
                    out.write(f"{value or ''}\n".encode())
            yield pd.DataFrame({"n": [len(b)]})

    return rows.select("name", "value").mapInPandas(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def result_pages(results: DataFrame, size: int = 100) -> DataFrame:
    """job_id, page, n, avg_confidence, categories, payload, checksum and next_page of pages of ``size`` results."""
    ordered = Window.partitionBy("job_id").orderBy("id")
    rows = results.withColumn("page", (F.floor((F.row_number().over(ordered) - 1) / size) + 1).cast("int"))
    sized = rows.groupBy("job_id", "page").agg(
        F.count("*").alias("n"), F.avg("confidence").alias("avg_confidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("categories")))).alias("categories"),
        F.to_json(F.array_sort(F.collect_list(F.struct("id", "chunk_id", "confidence", "extracted_data")))).alias("payload"),
    )
    last = results.groupBy("job_id").agg(F.ceil(F.count("*") / size).cast("int").alias("_last"))
    out = sized.withColumn("checksum", F.sha2("payload", 256)).join(last, "job_id")
    return out.withColumn("next_page", F.when(F.col("page") < F.col("_last"), F.col("page") + 1)).drop("_last")


def metrics_long(df: DataFrame) -> DataFrame:
    """metric and value of the numbers of rows."""
    numbers = [c for c, t in df.dtypes if t in ("int", "bigint", "double", "float")]
    return df.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, numbers)), F.array(*[F.col(c).cast("double") for c in numbers]))).alias("metric", "value"))


def quality_text(report: DataFrame, form: str = "text") -> str:
    """A quality report of a few rows as text, markdown or json."""
    rows = [r.asDict() for r in report.collect()]  # one row per metric
    if form == "json":
        return json.dumps(rows, indent=2)
    head = f"Overall score: {rows[0]['overall']:.3f} ({'passed' if rows[0]['overall_passed'] else 'failed'})" if rows else "No metrics"
    if form == "markdown":
        lines = ["| metric | score | threshold | passed |", "|---|---|---|---|", *(f"| {r['metric']} | {r['score']:.3f} | {r['threshold']} | {r['passed']} |" for r in rows)]
        return "\n".join(["# Quality report", "", head, "", *lines])
    return "\n".join([head, *(f"- {r['metric']}: {r['score']:.3f} (threshold {r['threshold']}, {'passed' if r['passed'] else 'failed'})" for r in rows)])
