"""Versions, jobs, question templates and metadata of documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import bound

VERSION = ["major", "minor", "patch"]


# -- versions ---------------------------------------------------------------------


def number(prefix: str = "") -> Column:
    return F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in VERSION])


def version_text(c: Column) -> Column:
    return F.concat_ws(".", *[c[x].cast("string") for x in VERSION])


def latest_version(versions: DataFrame) -> DataFrame:
    """The highest version of each dataset; of equal ones the last written."""
    best = F.max(F.struct(number().alias("v"), "version_id", "total_entries")).alias("x")
    return versions.groupBy("project_id", "dataset_name").agg(best).select("project_id", "dataset_name", version_text(F.col("x.v")).alias("version"), "x.version_id", "x.total_entries")


def next_version(versions: DataFrame, part: str) -> DataFrame:
    """dataset and its next version when ``part`` goes up."""
    v = F.col("v")
    up = {"major": (v["major"] + 1, F.lit(0), F.lit(0)), "minor": (v["major"], v["minor"] + 1, F.lit(0)), "patch": (v["major"], v["minor"], v["patch"] + 1)}[part]
    return versions.groupBy("project_id", "dataset_name").agg(F.max(number()).alias("v")).select("project_id", "dataset_name", F.concat_ws(".", *[x.cast("string") for x in up]).alias("next_version"))


def compare_versions(versions: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """Each dataset's lowest and highest version, the change of entries and which is newer."""
    out = versions.groupBy("project_id", "dataset_name").agg(F.min(F.struct(number().alias("v"), "version_id", "total_entries")).alias("a"), F.max(F.struct(number().alias("v"), "version_id", "total_entries")).alias("b"))
    relation = F.when(F.col("a.v") < F.col("b.v"), "older").otherwise("same")
    return out.select("project_id", "dataset_name", version_text(F.col("a.v")).alias("first_version"), version_text(F.col("b.v")).alias("second_version"), (F.col("b.total_entries") - F.col("a.total_entries")).alias("entry_delta"), relation.alias("relation"))


def rollback(versions: DataFrame, major: int, minor: int, patch: int) -> DataFrame:
    """Versions up to the target are active."""
    target = F.struct(F.lit(major).cast("long").alias("major"), F.lit(minor).cast("long").alias("minor"), F.lit(patch).cast("long").alias("patch"))
    own = F.struct(*[F.col(c).cast("long").alias(c) for c in VERSION])
    return versions.withColumn("is_active", own <= target)


# -- jobs -------------------------------------------------------------------------

TERMINAL = ("completed", "failed", "cancelled")


def status_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("status").agg(F.count("*").alias("n"))


def latest_status(events: DataFrame) -> DataFrame:
    """The last status of each job."""
    return events.groupBy("job_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("ts"))


def status_changes(events: DataFrame) -> DataFrame:
    """Events whose status differs from the one before."""
    before = F.lag("status").over(Window.partitionBy("job_id").orderBy("ts", "event_id"))
    return events.withColumn("previous", before).where(~F.col("previous").eqNullSafe(F.col("status"))).select("event_id", "job_id", "previous", "status")


def active_jobs(events: DataFrame) -> DataFrame:
    """Jobs that are running, in all and by the first digit of the job as user."""
    last = latest_status(events)
    return last.groupBy((F.col("job_id") % 10).alias("owner")).agg(F.count_if(F.col("status") == "running").alias("running"), F.count("*").alias("jobs"))


def stuck(events: DataFrame, now: str, seconds: int = 60) -> DataFrame:
    """Jobs whose last status is running and older than ``seconds``."""
    return latest_status(events).where((F.col("status") == "running") & (F.col("ts") <= F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(seconds)))).select("job_id")


def finished_before(events: DataFrame, now: str, hours: int = 48) -> DataFrame:
    """Finished jobs old enough to go."""
    return latest_status(events).where(F.col("status").isin(*TERMINAL) & (F.col("ts") < F.lit(now).cast("timestamp") - F.make_dt_interval(hours=F.lit(hours)))).select("job_id")


def job_analytics(events: DataFrame) -> DataFrame:
    """Per status: events, distinct jobs, mean time to the job's next event."""
    following = F.lead("ts").over(Window.partitionBy("job_id").orderBy("ts", "event_id"))
    seconds = F.unix_timestamp(F.col("_next").cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))
    return events.withColumn("_next", following).groupBy("status").agg(F.count("*").alias("n"), F.count_distinct("job_id").alias("jobs"), F.avg(seconds).alias("avg_seconds"))


def requests_in_window(events: DataFrame, by: str, ts: str, seconds: int = 60) -> DataFrame:
    """Events of the same client in the ``seconds`` up to each event."""
    at = F.unix_timestamp(F.col(ts).cast("timestamp"))
    own = Window.partitionBy(by).orderBy("_s").rangeBetween(-seconds, 0)
    return events.withColumn("_s", at).withColumn("n_in_window", F.count("*").over(own)).drop("_s")


# -- question templates -----------------------------------------------------------


# Question templates of domains, as (source category, target category, question, answer).
TEMPLATE_PACKS = {
    "medical": (
        ("symptoms", "disease_names", "A patient presents with {source_entity}. What is the most likely diagnosis?", "The patient likely has {target_entity} based on the presenting symptom of {source_entity}."),
        ("medications", "disease_names", "What condition is {source_entity} typically used to treat?", "{source_entity} is commonly used to treat {target_entity}."),
    ),
    "business": (
        ("products", "features", "What are the key features of {source_entity}?", "{source_entity} includes features such as {target_entity}."),
        ("companies", "products", "What products does {source_entity} offer?", "{source_entity} offers products including {target_entity}."),
    ),
}


def template_pack(spark: SparkSession, name: str, first_id: int = 1) -> DataFrame:
    """A domain's templates as rows: template_id, category, target_category, question and answer."""
    rows = [(first_id + k, *t) for k, t in enumerate(TEMPLATE_PACKS[name])]
    return spark.createDataFrame(rows, "template_id int, category string, target_category string, question string, answer string")


def expand_templates(relations: DataFrame, templates: DataFrame, most: int = 3, order: Sequence[str] = ()) -> DataFrame:
    """question and answer of each relation by the first ``most`` templates that apply to its category.

    Templates are rows (template_id, category or null for any, question, answer, and
    target_category where that matters too). Those of a category are one row that an
    equi-join finds, those for any are one row in all. Rows that share a key are one
    relation, so that a window has at most ``most`` times as many rows as a key; its
    questions of one template come in the order of the columns ``order``.
    """
    if "target_category" not in templates.columns:
        templates = templates.withColumn("target_category", F.lit(None).cast("string"))
    listed = F.array_sort(F.collect_list(F.struct("template_id", "target_category", "question", "answer")))
    own = templates.where("category IS NOT NULL").groupBy("category").agg(listed.alias("_own"))
    free = templates.where("category IS NULL").agg(listed.alias("_free"))
    both = relations.join(own, F.col("source_category") == F.col("category"), "left").crossJoin(F.broadcast(free))  # one row
    every = F.array_sort(F.concat(F.coalesce("_own", F.slice("_free", 1, 0)), "_free"))
    fits = F.filter(every, lambda t: t["target_category"].isNull() | F.coalesce(t["target_category"] == F.col("target_category"), F.lit(False)))
    fill = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("{source}"), F.col("source_entity")), F.lit("{target}"), F.col("target_entity")), F.lit("{source_entity}"), F.col("source_entity")), F.lit("{target_entity}"), F.col("target_entity"))
    chosen = both.select("l_orderkey", "l_linenumber", "source_entity", "target_entity", "confidence", *order, F.explode(F.slice(fits, 1, most)).alias("t"))
    rank = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("t.template_id", *order))
    chosen = chosen.withColumn("_r", rank).where(F.col("_r") <= most)
    return chosen.select("l_orderkey", "l_linenumber", "t.template_id", fill(F.col("t.question")).alias("question"), fill(F.col("t.answer")).alias("answer"), "confidence")


def dedup_answers(pairs: DataFrame, order: Sequence[str]) -> DataFrame:
    """The surest of equal questions and answers; of equally sure ones the first."""
    best = F.min_by(F.struct("confidence", *order), F.struct(-F.col("confidence"), *order)).alias("x")
    return pairs.groupBy("question", "answer").agg(best).select("question", "answer", "x.*")


def answer_stats(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count("*").alias("total"), F.count_distinct("template_id").alias("types"), F.avg("confidence").alias("avg_confidence"), F.count_distinct("question").alias("unique_questions"), F.count_distinct("answer").alias("unique_answers"))


# -- metadata of documents --------------------------------------------------------


# Patterns of titles, authors, dates and keywords, in the order in which they are tried.
TITLE = (r"^#\s+(.+)$", r"^(.+)\n={3,}", r"^(.+)\n-{3,}", r"Title:\s*(.+)$")
AUTHOR = (r"Author:\s*(.+)$", r"By:\s*(.+)$", r"Written by:\s*(.+)$", r"^(.+)\n.*(?:author|by|written)")
DATE = (r"Date:\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})", r"Published:\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})", r"(\d{1,2}[/-]\d{1,2}[/-]\d{4})", r"(\d{4}-\d{2}-\d{2})")
KEYWORDS, HEADING, BOLD = r"Keywords?:\s*(.+)$", r"^#{1,3}\s+(.+)$", r"\*\*(.+?)\*\*"
ANY_CASE = "(?dim)"  # lines end at a line feed


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _first(c: Column, *patterns: str, clean: str = "", least: int = 1, most: int = 10**9) -> Column:
    """The first pattern's first match of fitting length, trimmed and without what ``clean`` matches."""
    found = [_stripped(F.regexp_extract(c, ANY_CASE + p, 1)) for p in patterns]
    if clean:
        found = [_stripped(F.regexp_replace(x, clean, "")) for x in found]
    return F.coalesce(*[F.when(F.length(x).between(least, most), x) for x in found])


def title(c: Column, file_name: Column) -> Column:
    """A marked title of more than five characters, else the file name in title case."""
    stem = F.regexp_replace(F.regexp_replace(file_name, r"^.*/|\.[^.]*$", ""), "[_-]", " ")
    return F.coalesce(_first(c, *TITLE, least=6), F.initcap(stem))


def author(c: Column) -> Column:
    return _first(c, *AUTHOR, clean=r"(?U)[^\w\s,-]", least=3, most=99)


def published(c: Column) -> Column:
    return _first(c, *DATE)


def keywords(c: Column, top: int = 10) -> Column:
    """Named keywords, else headings and bold words of more than three characters; of more than two, each once in any case."""
    parts = lambda found: F.filter(F.transform(found, _stripped), lambda k: k != "")
    named = parts(F.split(F.regexp_extract(c, ANY_CASE + KEYWORDS, 1), "[;,]"))
    marked = F.filter(parts(F.concat(F.regexp_extract_all(c, F.lit("(?dm)" + HEADING), F.lit(1)), F.regexp_extract_all(c, F.lit("(?d)" + BOLD), F.lit(1)))), lambda k: F.length(k) > 3)
    found = F.filter(F.when(F.size(named) > 0, named).otherwise(marked), lambda k: F.length(k) > 2)
    once = lambda f: F.filter(f, lambda k, i: F.array_position(F.transform(f, F.lower), F.lower(k)) == i + 1)
    return F.slice(bound(found, once), 1, top)


def summary(c: Column) -> Column:
    """Up to three sentences of more than ten characters, cut to 200."""
    parts = F.filter(F.transform(F.split(c, r"[.!?]+"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: (F.length(s) > 10) & ~s.startswith("#"))
    text = F.concat(F.array_join(F.slice(parts, 1, 3), ". "), F.lit("."))
    return F.when(F.size(parts) == 0, "").when(F.length(text) > 200, F.concat(F.left(text, F.lit(197)), F.lit("..."))).otherwise(text)


def origin(c: Column, path: Column) -> Column:
    """A named source, else the folder of the file."""
    folder = F.try_element_at(F.split(path, r"[/\\]"), F.lit(-2))
    return F.coalesce(_first(c, r"(?im)^(?:source|from|citation):\s*(.+)$"), folder)


def metadata(docs: DataFrame, content: str, path: str) -> DataFrame:
    """title, author, date, keywords, summary and source beside the other columns."""
    c, p = F.coalesce(F.col(content), F.lit("")), F.coalesce(F.col(path), F.lit(""))
    return docs.withColumns({"title": title(c, p), "author": author(c), "date": published(c), "keywords": keywords(c), "summary": summary(c), "origin": origin(c, p)})


def cleaned_entities(c: Column, least: int) -> Column:
    """Trimmed texts longer than ``least``, each once in order."""
    return F.array_distinct(F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: F.length(x) > least))


def relevant(c: Column) -> Column:
    """Whether a category's value says something."""
    v = F.lower(F.trim(c))
    return (v != "") & ~v.isin("none", "null", "false", "0")
