"""Search over extraction results: id, job_id, project_id, chunk_id, categories, confidence, extracted_data, created_at.

Search parameters become one predicate, so that Spark pushes down what it can. Pages
are a sort with offset and limit, which Spark runs as a top-k; ties go to the id.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import islice

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.nested import texts
from ..functions.text import like_escaped, tokens

# Words an index leaves out.
STOP_WORDS = "a an and are as at be by for from has he in is it its of on that the to was will with".split()


def _like(c: Column, term: str) -> Column:
    return c.ilike(f"%{like_escaped(term)}%")


def predicate(query: str | None = None, categories: Sequence[str] = (), match_all: bool = False, min_confidence: float | None = None, date_from=None, date_to=None, chunk_id=None) -> Column:
    """Text in data or categories, categories by part of a name, least confidence, dates, chunk."""
    found = [F.lit(True)]
    if query:
        found.append(_like(F.col("extracted_data"), query) | F.exists("categories", lambda c: _like(c, query)))
    if categories:
        found.append(reduce(lambda a, b: a & b if match_all else a | b, map(_has, categories)))
    if min_confidence is not None:
        found.append(F.col("confidence") >= min_confidence)
    if date_from is not None:
        found.append(F.col("created_at") >= F.lit(date_from).cast("timestamp"))
    if date_to is not None:
        found.append(F.col("created_at") <= F.lit(date_to).cast("timestamp"))
    if chunk_id is not None:
        found.append(F.col("chunk_id") == chunk_id)
    return reduce(lambda a, b: a & b, found)


def _has(name: str) -> Column:
    return F.exists("categories", lambda c: _like(c, name))


def searchable(results: DataFrame) -> DataFrame:
    """id and text of results: their categories and all values of their data at any depth, in lower case."""
    own = texts(results.select("id", F.concat_ws(" ", "categories").alias("_c"), "extracted_data"), "extracted_data")
    return own.select("id", F.lower(F.concat_ws(" ", "_c", "text")).alias("text"))


def page(results: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page by confidence, then newest, then id."""
    return results.orderBy(F.col("confidence").desc(), F.col("created_at").desc(), "id").offset(offset).limit(limit)


def with_total(results: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page whose rows carry the number of all results."""
    total = results.agg(F.count("*").alias("total"))
    return page(results, limit, offset).crossJoin(F.broadcast(total))  # one row


def page_info(results: DataFrame, number: int, size: int) -> DataFrame:
    """total, total_pages, has_next and has_prev of page ``number`` from 1."""
    total = F.col("total")
    pages = F.ceil(total / size).cast("long")
    return results.agg(F.count("*").alias("total")).select("total", F.lit(number).alias("page"), pages.alias("total_pages"), (F.lit(number) < pages).alias("has_next"), (F.lit(number) > 1).alias("has_prev"))


def suggestions(results: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    """Categories and longer words of the data that start with ``prefix``, in order."""
    names = results.select(F.explode("categories").alias("suggestion"))
    own = results.select(F.explode(F.split(F.lower("extracted_data"), r"[^a-z0-9]+")).alias("suggestion")).where(F.length("suggestion") > 3)
    return names.unionByName(own).where(F.col("suggestion").ilike(f"{like_escaped(prefix)}%")).distinct().orderBy("suggestion").limit(limit)


def postings(docs: DataFrame, key: str = "doc_id", content: str = "text") -> DataFrame:
    """term and key, each once: lower-case words of more than two characters without stop words."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(content, F.lit(""))), F.lit(r"(?U)\b\w+\b"), F.lit(0)))
    return docs.select(key, F.explode(words).alias("term")).where((F.length("term") > 2) & ~F.col("term").isin(*STOP_WORDS))


def match_all_terms(index: DataFrame, terms: Sequence[str], key: str = "doc_id") -> DataFrame:
    """Keys that have every term the index knows; terms it lacks do not count."""
    wanted = sorted({t.lower() for t in terms if len(t) > 2} - set(STOP_WORDS))
    hits = index.where(F.col("term").isin(*wanted))
    known = hits.agg(F.count_distinct("term").alias("known"))
    return hits.groupBy(key).agg(F.count_distinct("term").alias("n")).crossJoin(F.broadcast(known)).where("n = known").select(key)  # one row


def category_index(results: DataFrame, categories: Sequence[str], chunk_id, date_from, date_to) -> DataFrame:
    """ids with one of the categories or of the chunk, within the dates; nothing found stays nothing."""
    by = results.where(F.arrays_overlap("categories", F.array(*map(F.lit, categories)))).select("id")
    chunk = results.where(F.col("chunk_id") == chunk_id).select("id")
    dated = results.where(F.col("created_at").between(F.lit(date_from).cast("timestamp"), F.lit(date_to).cast("timestamp"))).select("id")
    return by.union(chunk).distinct().join(dated, "id", "left_semi")


def validated(metadata: Column) -> Column:
    """Whether JSON metadata says ``is_validated``; missing is no."""
    return F.coalesce(F.get_json_object(metadata, "$.is_validated") == "true", F.lit(False))


def index_rows(results: DataFrame) -> DataFrame:
    """kind, term and id of an index by category, by chunk and by time."""
    by = lambda kind, term: results.select(F.lit(kind).alias("kind"), term.alias("term"), "id")
    rows = by("category", F.explode("categories")).unionByName(by("chunk", F.col("chunk_id").cast("string")))
    return rows.unionByName(by("time", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS")))


def updated_index(index: DataFrame, results: DataFrame) -> DataFrame:
    """An index with new results merged in, each entry once; a reader sorts by term."""
    return index.unionByName(index_rows(results)).distinct()


def pages(results: DataFrame, size: int = 100) -> Iterator[list[Row]]:
    """Results in id order, a page at a time as a caller asks: one sort by ranges, of which the driver holds one."""
    rows = results.orderBy("id").toLocalIterator()
    while page := list(islice(rows, size)):
        yield page


def expired(results: DataFrame, now, days: int = 30) -> Column:
    """Whether a result is older than ``days``."""
    return F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days)) > F.col("created_at")


def retention(results: DataFrame, now, days: int = 30) -> DataFrame:
    """total, candidates, pct and bytes that leaving them out frees."""
    old = expired(results, now, days)
    out = results.agg(F.count("*").alias("total"), F.count_if(old).alias("candidates"), F.coalesce(F.sum(F.when(old, F.length("extracted_data") + 100)), F.lit(0)).alias("bytes_freed"))
    return out.withColumn("pct", F.when(F.col("total") > 0, F.col("candidates") * 100.0 / F.col("total")).otherwise(0.0))


def budget_oldest_first(results: DataFrame, budget: int, key: str = "job_id"):
    """Rows per key, oldest first, that fit a budget of bytes; a row that does not fit is skipped, later ones may fit.

    A greedy fold over ordered rows of a key, streamed with the sum alone held.
    """
    import pandas as pd

    kind = results.schema[key].dataType.simpleString()

    def fold(batches):
        last, used = None, 0
        for b in batches:
            keep = []
            for k, n in zip(b[key], b["size"], strict=True):
                used = 0 if k != last else used
                last = k
                keep.append(used + n <= budget)
                used += n if keep[-1] else 0
            yield pd.DataFrame({key: b[key], "id": b["id"], "kept": keep})

    rows = results.select(key, "id", "created_at", (F.length("extracted_data") + 100).alias("size"))
    return rows.repartition(key).sortWithinPartitions(key, "created_at", "id").select(key, "id", "size").mapInPandas(fold, f"{key} {kind}, id long, kept boolean")


def facet_counts(docs: DataFrame, content: str = "text", top: int = 20) -> DataFrame:
    """The most frequent words of texts."""
    return docs.select(F.explode(tokens(F.col(content))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "word").limit(top)
