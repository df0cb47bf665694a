"""Exports under a chosen file name, with a fixed header, that appear whole or not at all.

    spark.dataSource.register(NamedExport)
    df.write.format("named_export").option("path", folder).option("name", "jobs.csv").mode("overwrite").save()

Tasks write files of their own under a hidden folder; the commit gives them their names
and the abort takes them away, so that a lost task or job leaves no part behind. One
partition becomes the very name; more become ``name-00001-of-00007.csv`` and so on, each
with the header. The driver renames and never reads them.
"""

from __future__ import annotations

import csv
import io
import json
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Headers of summaries as CSV, with the column each comes from and what stands where it is missing.
HEADERS = {
    "qa": (("Question", "question", ""), ("Answer", "answer", ""), ("Context", "context", ""), ("QA_Type", "qa_type", ""), ("Confidence", "confidence", "")),
    "jobs": (
        ("job_id", "job_id", ""), ("status", "status", ""), ("created_at", "created_at", ""), ("progress_percentage", "progress_percentage", "0"),
        ("project_id", "project_id", ""), ("taxonomy_id", "taxonomy_id", ""), ("extraction_type", "extraction_type", ""), ("extraction_mode", "extraction_mode", ""),
    ),
    "datasets": (
        ("id", "id", ""), ("name", "name", ""), ("format_type", "format_type", ""), ("created_at", "created_at", ""),
        ("file_size", "file_size", "0"), ("record_count", "record_count", "0"), ("chunking_strategy", "chunking_strategy", ""), ("embedding_model", "embedding_model", ""),
    ),
    "taxonomies": (
        ("ID", "id", ""), ("Name", "name", "Unknown"), ("Project_ID", "project_id", ""), ("Categories_Count", "categories_count", "0"),
        ("Confidence_Score", "confidence_score", "0.0"), ("Created_At", "created_at", "Unknown"),
    ),
}


@dataclass
class Part(WriterCommitMessage):
    path: str
    partition: int
    rows: int


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9+]+:/", path) else (fs.LocalFileSystem(), path)


class NamedWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        self.path, self.name, self.columns = options["path"], options["name"], schema.names
        self.form = options.get("form", self.name.rsplit(".", 1)[-1]).lower()
        if self.form not in ("csv", "json", "jsonl") or "/" in self.name:
            raise ValueError("need a name that ends in .csv, .json or .jsonl")
        self.overwrite, self.job = overwrite, uuid.uuid4().hex
        self.hidden = f".export-{self.job}"
        system, root = _place(self.path)
        system.create_dir(posixpath.join(root, self.hidden), recursive=True)  # here, so that no late task makes it anew after an abort

    def _line(self, row) -> str:
        if self.form == "csv":
            out = io.StringIO()
            csv.writer(out, lineterminator="\n").writerow(["" if v is None else ", ".join(map(str, v)) if isinstance(v, (list, tuple)) else v for v in row])
            return out.getvalue()
        return json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str)

    def write(self, iterator: Iterator) -> Part:
        """One file of a task's rows: CSV with its header, a JSON list, or JSON lines."""
        context = TaskContext.get()
        number, attempt = context.partitionId(), context.taskAttemptId()
        system, root = _place(self.path)
        path, n = posixpath.join(root, self.hidden, f"{number}-{attempt}"), 0
        with system.open_output_stream(path) as out:
            if self.form == "csv":
                out.write((",".join(self.columns) + "\n").encode())
            elif self.form == "json":
                out.write(b"[")
            for n, row in enumerate(iterator, 1):
                text = self._line(row)
                out.write({"csv": text, "jsonl": f"{text}\n", "json": ("\n  " if n == 1 else ",\n  ") + text}[self.form].encode())
            if self.form == "json":
                out.write(b"\n]\n" if n else b"]\n")
        return Part(path, number, n)

    def _names(self, n: int) -> list[str]:
        stem, dot, suffix = self.name.rpartition(".")
        return [self.name] if n == 1 else [f"{stem}-{k:05d}-of-{n:05d}{dot}{suffix}" for k in range(1, n + 1)]

    def commit(self, messages: list) -> None:
        """Files with rows (or one without, if none has any) get their names; others of this export go."""
        system, root = _place(self.path)
        parts = sorted((m for m in messages if m), key=lambda m: m.partition)
        parts = [m for m in parts if m.rows] or parts[:1]
        stem, _, suffix = self.name.rpartition(".")
        of = re.compile(rf"{re.escape(stem)}(-\d{{5}}-of-\d{{5}})?\.{re.escape(suffix)}")
        old = [f.path for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if of.fullmatch(posixpath.basename(f.path))]
        if old and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(old[0])
        for path in old:
            system.delete_file(path)
        for m, name in zip(parts, self._names(len(parts))):
            system.move(m.path, posixpath.join(root, name))
        system.delete_dir(posixpath.join(root, self.hidden))

    def abort(self, messages: list) -> None:
        system, root = _place(self.path)
        folder = posixpath.join(root, self.hidden)
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


class NamedExport(DataSource):
    """The format ``named_export``; options path, name and form (csv, json, jsonl; by the name's suffix)."""

    @classmethod
    def name(cls) -> str:
        return "named_export"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return NamedWriter(dict(self.options), schema, overwrite)


def fixed(df: DataFrame, kind: str) -> DataFrame:
    """The summary of a kind of export: its columns as text under their headers; missing ones and nulls have defaults."""
    value = lambda column, default: F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(default)) if column in df.columns else F.lit(default)
    return df.select(*[value(column, default).alias(header) for header, column, default in HEADERS[kind]])


def benchmark_summary(df: DataFrame, suite: str = "glue") -> DataFrame:
    """Benchmark results without nesting: model_name and model_provider of model_info, accuracy and f1_score of performance_data, both JSON.

    What is missing is ``Unknown``, or ``N/A`` for scores; other columns stay.
    """
    get = lambda column, path: F.try_variant_get(F.try_parse_json(F.col(column).cast("string")), path, "string")
    rest = [c for c in df.columns if c not in ("model_info", "performance_data")]
    named = [F.coalesce(get("model_info", f"$.{k}"), F.lit("Unknown")).alias(f"model_{k}") for k in ("name", "provider")] if "model_info" in df.columns else []
    scores = [F.coalesce(get("performance_data", f"$.{suite}.{k}.mean"), F.lit("N/A")).alias(c) for k, c in (("accuracy", "accuracy"), ("f1", "f1_score"))] if "performance_data" in df.columns else []
    return df.select(*rest, *named, *scores)


def export(df: DataFrame, path: str, name: str, kind: str | None = None, order: tuple[str, ...] = (), overwrite: bool = True, rows_per_file: int = 1_000_000) -> None:
    """Rows as one file of a chosen name, or as numbered files of about ``rows_per_file`` rows each.

    With a ``kind`` CSV has that summary's columns; JSON has all columns. ``order`` sorts rows through all files.
    """
    df.sparkSession.dataSource.register(NamedExport)
    files = max(1, -(-df.count() // rows_per_file))
    dealt = df.repartitionByRange(files, *order).sortWithinPartitions(*order) if order else df.repartition(files)
    dealt = fixed(dealt, kind) if kind and name.endswith(".csv") else dealt
    dealt.write.format("named_export").option("path", path).option("name", name).mode("overwrite" if overwrite else "append").save()


def files(path: str, name: str) -> str:
    """A glob of what an export of this name left in a folder: the one file, or the numbered ones."""
    stem, dot, suffix = name.rpartition(".")
    return f"{path}/{stem}{{,-*-of-*}}{dot}{suffix}"
