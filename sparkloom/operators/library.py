"""Smaller operators: listings, integrity, hooks, lineage, extracted entities."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import ranked
from .records import VERSION, number, version_text


def page_listing(rows: DataFrame, order: Sequence[Column], page: int, per_page: int) -> DataFrame:
    """One page of a listing."""
    return rows.orderBy(*order).offset((page - 1) * per_page).limit(per_page)


def category_texts(results: DataFrame, entities: str) -> DataFrame:
    """Per category all texts of its entities over all results; empty categories go."""
    rows = results.select(F.explode(entities).alias("category", "texts")).select("category", F.explode("texts").alias("t")).where(F.trim("t") != "")
    return rows.groupBy("category").agg(F.count("*").alias("n"), F.count_distinct("t").alias("n_distinct"), F.min("t").alias("first"), F.max("t").alias("last"))


def keep_known(found: Column, known: Column) -> Column:
    """Entries of a map whose key another map has: a second pass adds no categories."""
    return F.map_filter(found, lambda k, v: F.array_contains(F.map_keys(known), k))


def kept_entities(found: Column, least: int) -> Column:
    """Entities longer than ``least``, trimmed and each once; categories left empty go."""
    clean = F.transform_values(found, lambda k, v: F.array_distinct(F.filter(F.transform(v, lambda x: F.trim(x)), lambda x: F.length(x) > least)))
    return F.map_filter(clean, lambda k, v: F.size(v) > 0)


def top_of_map(scores: Column, n: int) -> Column:
    """Names of the ``n`` highest values of a map; ties by name."""
    ordered = F.array_sort(F.transform(F.map_entries(scores), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k"))))
    return F.transform(F.slice(ordered, 1, n), lambda e: e["k"])


def strongest(found: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` strongest correlations between different things."""
    return found.where("factor <> metric").orderBy(F.abs("r").desc(), "factor", "metric").limit(n)


def last_n(events: DataFrame, by: str, order: Sequence[str], n: int) -> DataFrame:
    """The last ``n`` rows of each group; Spark cuts groups before it shuffles them."""
    return events.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*[F.col(c).desc() for c in order]))).where(F.col("_r") <= n).drop("_r")


def with_files(files: DataFrame, versions: DataFrame, path: str, name: str) -> DataFrame:
    """Files with the version whose name is their last path part: an equi-join, not a LIKE."""
    return files.withColumn("_name", F.regexp_extract(path, r"([^/\\]+)$", 1)).join(versions, F.col("_name") == F.col(name), "left").drop("_name")


def integrity(pages: DataFrame, payload: str = "payload", checksum: str = "checksum") -> DataFrame:
    """total, valid and corrupted pages."""
    ok = F.coalesce(F.sha2(F.col(payload).cast("binary"), 256) == F.col(checksum), F.lit(False))
    return pages.agg(F.count("*").alias("total"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("corrupted"))


def success_summary(rows: DataFrame, ok: Column, skipped: Column) -> DataFrame:
    """total, processed, filtered, failed and success rate."""
    out = rows.agg(F.count("*").alias("total"), F.count_if(ok).alias("processed"), F.count_if(skipped).alias("filtered"), F.count_if(~ok & ~skipped).alias("failed"))
    return out.withColumn("success_rate", F.when(F.col("total") > 0, F.col("processed") / F.col("total")).otherwise(0.0))


def owner_statistics(owners: DataFrame, items: DataFrame, key: str, owner: str) -> DataFrame:
    """Owners, items and the mean of items per owner, owners without any included."""
    counts = items.groupBy(F.col(owner).alias("_o")).agg(F.count("*").alias("_n"))
    joined = owners.select(key).join(counts, F.col(key) == F.col("_o"), "left").select(F.coalesce("_n", F.lit(0)).alias("n"))
    return joined.agg(F.count("*").alias("owners"), F.coalesce(F.sum("n"), F.lit(0)).alias("items"), F.avg("n").alias("avg_items"))


def create_version(versions: DataFrame, entries: DataFrame, project_id: int, name: str, part: str = "patch") -> DataFrame:
    """``versions`` and one more row: the next version of a dataset with the digest of its entries; 1.0.0 if it is the first."""
    v = F.col("v")
    up = {"major": (v["major"] + 1, 0, 0), "minor": (v["major"], v["minor"] + 1, 0), "patch": (v["major"], v["minor"], v["patch"] + 1)}[part]
    last = versions.where((F.col("project_id") == project_id) & (F.col("dataset_name") == name)).agg(F.max(number()).alias("v"))
    size = entries.agg(F.count("*").alias("total_entries"), F.sum(F.xxhash64(*entries.columns).cast("decimal(38,0)")).alias("s"))  # the order of entries doesn't matter
    new = [F.when(v.isNull(), 1 if k == 0 else 0).otherwise(x).cast(versions.schema[c].dataType).alias(c) for k, (c, x) in enumerate(zip(VERSION, up, strict=True))]
    row = last.crossJoin(size).select(F.lit(project_id).alias("project_id"), F.lit(name).alias("dataset_name"), *new, "total_entries", F.sha2(F.coalesce(F.col("s").cast("string"), F.lit("")), 256).alias("digest"))  # one row each
    return versions.unionByName(row, allowMissingColumns=True)


def record_incremental(versions: DataFrame, changes: DataFrame, new: DataFrame, project_id: int, name: str) -> tuple[DataFrame, DataFrame]:
    """versions and changes after new entries came to a dataset: its next patch version, and what was added.

    A dataset without a version is an error of the job that reads the result.
    """
    own = versions.where((F.col("project_id") == project_id) & (F.col("dataset_name") == name))
    last = own.agg(F.max(F.struct(number().alias("v"), "version_id", "total_entries")).alias("x"), F.max("version_id").alias("m"))
    added = new.agg(F.count("*").alias("added"))
    v = F.col("x.v")
    known = F.when(F.col("x").isNull(), F.raise_error(F.lit(f"no version of {name}"))).otherwise(v["patch"] + 1)
    top = versions.agg((F.coalesce(F.max("version_id"), F.lit(0)) + 1).alias("version_id"))
    row = last.crossJoin(added).crossJoin(top).select(  # one row each
        F.col("version_id"), F.lit(project_id).alias("project_id"), F.lit(name).alias("dataset_name"), v["major"].alias("major"), v["minor"].alias("minor"), known.alias("patch"),
        (F.col("x.total_entries") + F.col("added")).alias("total_entries"), "added",
    )
    kinds = dict(versions.dtypes)
    made = row.select(*[F.col(c).cast(kinds[c]).alias(c) for c in row.columns if c in kinds])
    change = row.select(F.col("version_id").cast(dict(changes.dtypes)["version_id"]).alias("version_id"), F.concat(F.lit("incremental: added "), F.col("added").cast("string"), F.lit(" entries")).alias("change"))
    return versions.unionByName(made, allowMissingColumns=True), changes.unionByName(change, allowMissingColumns=True)


def schema_problems(df: DataFrame, wanted: Mapping[str, str]) -> list[str]:
    """What a result file's columns lack of the wanted names and types, before anything is read."""
    kinds = dict(df.dtypes)
    return [f"no column {c}" if c not in kinds else f"{c} is {kinds[c]}, not {t}" for c, t in wanted.items() if kinds.get(c) != t]


def manifests(files: DataFrame, per_part: int = 1000) -> DataFrame:
    """document_id, part, total_files, total_length and files (in order, as a list) of documents parsed to several files.

    A manifest has ``per_part`` files a part, so that no row grows with a document.
    """
    numbered = ranked(files.select("document_id", "file_seq", "file_path"), [F.col("document_id")], F.floor(F.col("file_seq") / 1_000_000), ["file_seq"])
    parts = numbered.withColumn("part", (F.floor((F.col("_rank") - 1) / per_part) + 1).cast("int"))
    listed = parts.groupBy("document_id", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("file_seq", "file_path"))), lambda x: x["file_path"]).alias("files"))
    totals = files.groupBy("document_id").agg(F.count("*").alias("total_files"), F.sum("content_length").alias("total_length"))
    return listed.join(totals, "document_id").select("document_id", "part", "total_files", "total_length", "files")


def split_manifests(splits: DataFrame) -> DataFrame:
    """Files of page splits, as rows that ``manifests`` takes: file_path names the document, the split and its pages.

    splits: document_id, chunk_number, start_page, end_page and content_length.
    """
    name = F.format_string("%s_split_%03d_p%d-%d.json", F.col("document_id").cast("string"), "chunk_number", "start_page", "end_page")
    return splits.select("document_id", F.col("chunk_number").alias("file_seq"), name.alias("file_path"), "content_length")


def history(versions: DataFrame, changes: DataFrame) -> DataFrame:
    """Versions of each dataset in order with their changes as one text."""
    own = changes.groupBy("version_id").agg(F.array_join(F.array_sort(F.collect_list("change")), ",").alias("changes"))
    return versions.join(own, "version_id", "left").select("project_id", "dataset_name", version_text(number()).alias("version"), "version_id", F.coalesce("changes", F.lit("")).alias("changes"))


def lineage(version_id: Column, rows: DataFrame, **sources: Column) -> DataFrame:
    """version_id, source_type and source_id for each kind of source a version has."""
    pairs = F.array(*[F.struct(F.lit(k).alias("source_type"), c.cast("string").alias("source_id")) for k, c in sources.items()])
    return rows.select(version_id.alias("version_id"), F.explode(pairs).alias("s")).select("version_id", "s.*").where("source_id IS NOT NULL")


def project_of(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, r"storage/uploads/([^/]+)", 1), F.lit(""))


def first_chunks(chunks: DataFrame, by: str, order: str, content: str, n: int = 10) -> DataFrame:
    """Each group's first ``n`` chunks joined by rules."""
    rows = chunks.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("_r") <= n)
    return rows.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.col(content).alias("c")))), lambda x: x["c"]), "\n\n---\n\n").alias("sample"))


def in_batches(rows: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A function of frames over all rows, a batch of a partition at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield work(b)

    return rows.mapInPandas(run, schema)


def hooks(rows: DataFrame, before: Sequence[Callable[[DataFrame], DataFrame]] = (), after: Sequence[Callable[[DataFrame], DataFrame]] = (), step: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """A step with what comes before and after it."""
    for f in (*before, step, *after):
        rows = rows.transform(f)
    return rows


def gate(report: DataFrame, column: str, least: float) -> DataFrame:
    """A report whose rows raise an error when a score is below ``least``."""
    c = F.col(column)
    return report.withColumn(column, F.when(c < least, F.raise_error(F.concat(F.lit(f"{column} below {least}: "), c.cast("string")))).otherwise(c))
