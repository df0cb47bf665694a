"""Readers: files of many shapes to rows of text.

Everything but folders of many small files is read by Spark's own sources, so that paths
may be of any file system; parsers of binary formats are functions of bytes that a registry holds.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Parser = Callable[[bytes], str]
PARSERS: dict[str, Parser] = {}
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
BATCH_BYTES, BATCH_FILES = 4 << 20, 1000  # of texts that leave a task at once


def register_parser(suffix: str, parser: Parser) -> None:
    """Texts of files with this suffix come from ``parser``."""
    PARSERS[suffix.lower().lstrip(".")] = parser


def register_reader(name: str, reader: Callable[[SparkSession, str], DataFrame]) -> None:
    """A whole-format plug-in, tried before anything else."""
    READERS[name] = reader


def documents(spark: SparkSession, path: str, reader: str | None = None) -> DataFrame:
    """path and content of files: a named reader, else a parser by suffix, else UTF-8 text, unreadable bytes dropped."""
    if reader:
        return READERS[reader](spark, path)
    parsers = dict(PARSERS)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [parsers.get(p.rsplit(".", 1)[-1].lower(), lambda x: bytes(x).decode("utf-8", "ignore"))(c) for p, c in zip(b["path"], b["content"], strict=True)]
            yield pd.DataFrame({"path": b["path"], "content": texts})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(read, "path string, content string")


def parsed_files(spark: SparkSession, path: str) -> DataFrame:
    """path and main_content: that field of a JSON file, else the text as it is."""
    return small_files(spark, path).select("path", main_content(F.col("value")).alias("main_content"))


def small_files(spark: SparkSession, path: str) -> DataFrame:
    """path and value of the files, each whole, that Spark's text source would read at a path or glob.

    That source keeps the status of every file on the driver and puts some 30 small files into a
    task. Here the driver finds what the path names, folders in general; tasks list them, and
    files are dealt by their paths to a fixed number of tasks, each of which reads its own one by one.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    named = [(re.sub(r"^file:/+", "file:/", x.getPath().toUri().toString()), x.isDirectory()) for x in system.globStatus(hadoop) or []]
    if not named:
        raise FileNotFoundError(path)
    n = spark.sparkContext.defaultParallelism
    found = spark.createDataFrame(named, "uri string, folder boolean").repartition(min(len(named), 4 * n), "uri").mapInPandas(_below, "path string, file string")
    return found.repartition(4 * n, "file").mapInArrow(_contents, "path string, value binary").select("path", F.col("value").cast("string").alias("value"))


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Hadoop writes it, and the path there."""
    return fs.FileSystem.from_uri(re.sub(r"[^\x00-\x7f]+", lambda m: quote(m[0]), re.sub(r"^file:/+", "file:///", uri)))


def _below(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Files in folders and in their key=value folders, but hidden and empty ones: as Hadoop writes them, and below their file system."""
    escaped = lambda x: re.sub(r"[\x00-\x20\"#%<>?\[\\\]^`{|}\x7f]", lambda m: f"%{ord(m[0]):02X}", x)
    for b in batches:
        for uri, folder in zip(b["uri"], b["folder"], strict=True):
            system, where = _opened(uri)
            todo = [fs.FileSelector(where) if folder else [where]]
            while todo:
                seen = [f for f in system.get_file_info(todo.pop()) if not re.match(r"\.|_[^=]*$", f.base_name)]
                todo += [fs.FileSelector(f.path) for f in seen if f.type == fs.FileType.Directory and "=" in f.base_name]
                files = [f.path for f in seen if f.type == fs.FileType.File and f.size]
                yield pd.DataFrame({"path": [uri + escaped(f[len(where) :]) for f in files], "file": files}, dtype="object")


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Path and bytes of files, some at a time."""
    systems, paths, texts, size = {}, [], [], 0
    out = lambda: pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.binary())], ["path", "value"])
    for b in batches:
        for path, file in zip(b["path"].to_pylist(), b["file"].to_pylist(), strict=True):
            root = re.match(r"[^:/]+:(//[^/]*)?", path)[0]
            if root not in systems:
                systems[root] = _opened(f"{root}/")[0]
            with systems[root].open_input_stream(file) as f:  # by its suffix, a compressed one is opened as such
                texts.append(f.read())
            paths.append(path)
            size += len(texts[-1])
            if size >= BATCH_BYTES or len(texts) >= BATCH_FILES:
                yield out()
                paths, texts, size = [], [], 0
    if texts:
        yield out()


def main_content(c):
    """The main_content of a JSON object, else the text."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(c), "$.main_content", "string"), c)


def json_entries(spark: SparkSession, path: str) -> DataFrame:
    """entry, one JSON object as text each: from lists, single objects, lists of JSON strings, lines with or without commas."""
    text = spark.read.text(path, wholetext=True)
    return entries(text.select(F.col("value").alias("text")))


def entries(texts: DataFrame) -> DataFrame:
    """entry of every text of column ``text``."""
    t = F.trim(F.col("text"))
    whole = F.from_json(t, "array<string>")
    lines = F.filter(F.transform(F.split(t, r"\r?\n"), lambda x: F.regexp_replace(F.trim(x), r",\s*$", "")), lambda x: x != "")
    valid = F.try_parse_json(t).isNotNull()
    each = (F.size(lines) > 1) & F.forall(lines, lambda x: F.try_parse_json(x).isNotNull() & x.rlike(r'^[{"]'))
    parts = F.when(each, lines).when(valid & t.startswith("["), whole).when(valid, F.array(t)).otherwise(F.filter(lines, lambda x: F.try_parse_json(x).isNotNull() & ~x.rlike(r"^[\[\]]$")))
    rows = texts.select(F.explode(parts).alias("entry"))
    nested = F.try_variant_get(F.try_parse_json("entry"), "$", "string")
    return rows.select(F.when(F.col("entry").startswith('"') & nested.isNotNull(), nested).otherwise(F.col("entry")).alias("entry"))


def chunks_of(texts: DataFrame) -> DataFrame:
    """chunk of every text: a JSON list, an object with ``chunks``, one object's text, or the text itself."""
    v = F.try_parse_json("text")
    of = lambda p: F.try_variant_get(v, p, "array<string>")
    one = F.coalesce(F.try_variant_get(v, "$.text", "string"), F.try_variant_get(v, "$.content", "string"))
    found = F.coalesce(of("$"), of("$.chunks"), F.when(one.isNotNull(), F.array(one)), F.array("text"))
    return texts.select(*[c for c in texts.columns if c != "text"], F.posexplode(found).alias("ord", "chunk"))


def valid_chunks(chunks: DataFrame, key: str = "chunk_id", content: str = "chunk") -> DataFrame:
    """Chunks with an id and a text that is not blank."""
    return chunks.where(F.col(key).isNotNull() & (F.trim(F.coalesce(F.col(content), F.lit(""))) != ""))


def project_chunks(chunks: DataFrame, docs: DataFrame, project, most: int | None = None) -> DataFrame:
    """Chunks of a project's documents, newest first, at most ``most``."""
    own = docs.where(F.col("project_id") == project).select("document_id")
    found = chunks.join(own, "document_id").orderBy(F.col("created_at").desc(), "chunk_index")
    return found if most is None else found.limit(most)


def first_match(spark: SparkSession, pattern: str) -> DataFrame:
    """path and value of the first file, in order of paths, that a glob names; the others are listed, not read."""
    first = spark.read.format("binaryFile").load(pattern).agg(F.min("path")).first()[0]
    if first is None:
        return spark.createDataFrame([], "path string, value string")
    return spark.read.text(first, wholetext=True).select(F.lit(first).alias("path"), "value")


def directory_statistics(spark: SparkSession, path: str) -> DataFrame:
    """directory, files, mb and avg_kb of what lies below a path; sizes come from the listing, no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    own = files.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("directory"), "length")
    return own.groupBy("directory").agg(F.count("*").alias("files"), (F.sum("length") / 1048576).alias("mb"), (F.avg("length") / 1024).alias("avg_kb"))


def task_split(spark: SparkSession, path: str, task: str) -> DataFrame:
    """text and label of a benchmark task's validation split, from Parquet or JSON lines at ``path``/task/split.*"""
    from ..operators.evaluation import TASK_COLUMNS, TASK_SPLIT, task_inputs

    if task not in TASK_COLUMNS:
        raise ValueError(f"unknown task {task}")
    where = f"{path}/{task}/{TASK_SPLIT.get(task, 'validation')}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{where}.parquet")
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return task_inputs(spark.read.parquet(f"{where}.parquet") if there else spark.read.json(f"{where}.jsonl"), task)


def is_text_document(first_page) -> object:
    """Whether a document's first page has enough text not to be a scan."""
    return F.length(first_page) > 500


def checked_results(spark: SparkSession, path: str) -> DataFrame:
    """Rows of result pages whose checksum holds, with page and file."""
    pages = spark.read.parquet(path)
    return pages.withColumn("valid", F.sha2(F.col("payload"), 256) == F.col("checksum"))
