"""Queries over listings, entities, integrity, history and lineage."""

from pyspark.sql import functions as F

from ..functions import replies as P
from ..operators import evaluation as E
from ..operators import library as L
from ..session import table
from ..sources import writers as O
from .catalog import query
from .q_evaluation import MONTHS
from .q_quality import r6
from .views import view


@query("listing_page", "SELECT version_id, dataset_name FROM v_versions WHERE dataset_name ILIKE '%2%' AND total_entries BETWEEN 100 AND 400 ORDER BY version_id DESC LIMIT 20 OFFSET 20")
def listing_page(spark, d):
    """The second page of datasets by a part of their name and their size, newest first."""
    rows = view(spark, d, "v_versions").where(F.col("dataset_name").ilike("%2%") & F.col("total_entries").between(100, 400))
    return L.page_listing(rows, [F.col("version_id").desc()], 2, 20).select("version_id", "dataset_name")


@query("category_texts", """WITH e AS (SELECT source AS category, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '')) AS t FROM documents)
SELECT category, count(*) AS n, count(DISTINCT t) AS n_distinct, min(t) AS first, max(t) AS last FROM e GROUP BY category""")
def category_texts(spark, d):
    words = F.split("text", r"\s+")
    return L.category_texts(table(spark, d, "documents").select(F.create_map("source", words).alias("entities")), "entities")


@query("known_categories", "SELECT event_id, CASE WHEN value > 100 THEN 'a,type' ELSE 'type' END AS kept FROM events")
def known_categories(spark, d):
    """A second pass may not add categories; short entities go."""
    first = F.create_map(F.lit("type"), F.array("event_type"), F.lit("a"), F.array(F.when(F.col("value") > 100, " long enough ").otherwise("x")))
    second = F.map_concat(first, F.create_map(F.lit("new"), F.array(F.lit("value"))))
    return table(spark, d, "events").select("event_id", F.array_join(F.array_sort(F.map_keys(L.kept_entities(L.keep_known(second, first), 1))), ",").alias("kept"))


@query("top_categories", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'size,fixed' WHEN p_size = 25 THEN 'fixed,size' ELSE 'fixed,size' END AS top FROM part")
def top_categories(spark, d):
    scores = F.create_map(F.lit("size"), F.col("p_size").cast("double"), F.lit("fixed"), F.lit(25.0), F.lit("none"), F.lit(-1.0))
    return table(spark, d, "part").select("p_partkey", F.array_join(L.top_of_map(scores, 2), ",").alias("top"))


@query("top_correlations", f"""WITH {MONTHS}, j AS (SELECT a.benchmark AS factor, b2.benchmark AS metric, a.v AS x, b2.v AS y FROM b a JOIN b b2 ON a.model_name = b2.model_name AND a.month = b2.month)
SELECT factor, metric, round(corr(x, y), 6) AS r FROM j WHERE factor <> metric GROUP BY ALL ORDER BY abs(round(corr(x, y), 9)) DESC, factor, metric LIMIT 3""")
def top_correlations(spark, d):
    monthly = view(spark, d, "v_runs").groupBy("model_name", F.date_trunc("month", "ts").alias("month"), "benchmark").agg(F.avg("value").alias("v"))
    side = lambda a, b: monthly.select("model_name", "month", F.col("benchmark").alias(a), F.col("v").alias(b))
    found = E.correlations(side("factor", "x"), side("metric", "y"), ["model_name", "month"])
    return L.strongest(found.withColumn("r", F.round("r", 9)), 3).select("factor", "metric", F.round("r", 6).alias("r"))


@query("rolling_last", "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 5")
def rolling_last(spark, d):
    return L.last_n(table(spark, d, "events"), "user_id", ["ts", "event_id"], 5).select("event_id", "user_id")


@query("file_versions", "SELECT doc_id, p_partkey AS version_id FROM documents LEFT JOIN part ON p_partkey = doc_id AND p_size > 10")
def file_versions(spark, d):
    """Files joined to versions by the file's name."""
    files = table(spark, d, "documents").select("doc_id", F.concat(F.lit("data/out/v_"), F.col("doc_id").cast("string")).alias("file_path"))
    versions = table(spark, d, "part").where("p_size > 10").select(F.concat(F.lit("v_"), F.col("p_partkey").cast("string")).alias("filename"), F.col("p_partkey").alias("version_id"))
    return L.with_files(files, versions, "file_path", "filename").select("doc_id", "version_id")


@query("integrity_report", "SELECT count(*) AS total, count(*) - CAST(count_if(job_id = 3) AS BIGINT) AS valid, CAST(count_if(job_id = 3) AS BIGINT) AS corrupted FROM (SELECT DISTINCT job_id, (k - 1) // 100 AS p FROM (SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY id) AS k FROM v_results))")
def integrity_report(spark, d):
    pages = O.result_pages(view(spark, d, "v_results"))
    return L.integrity(pages.withColumn("payload", F.when(F.col("job_id") == 3, F.concat("payload", F.lit(" "))).otherwise(F.col("payload"))))


@query("success_summary", "SELECT count(*) AS total, CAST(count_if(value > 100) AS BIGINT) AS processed, CAST(count_if(value <= 100 AND value > 20) AS BIGINT) AS filtered, CAST(count_if(value <= 20) AS BIGINT) AS failed, round(count_if(value > 100)::DOUBLE / count(*), 6) AS success_rate FROM events")
def success_summary(spark, d):
    v = F.col("value")
    return r6(L.success_summary(table(spark, d, "events"), v > 100, (v <= 100) & (v > 20)))


@query("owner_statistics", "SELECT count(*) AS owners, CAST(sum(n) AS BIGINT) AS items, round(avg(n), 6) AS avg_items FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)")
def owner_statistics(spark, d):
    return r6(L.owner_statistics(table(spark, d, "customer"), table(spark, d, "orders"), "c_custkey", "o_custkey"))


@query("version_history", "SELECT project_id, dataset_name, major || '.' || minor || '.' || patch AS version, version_id, CASE WHEN version_id % 3 = 0 THEN 'add,edit' ELSE '' END AS changes FROM v_versions")
def version_history(spark, d):
    versions = view(spark, d, "v_versions")
    changes = versions.where("version_id % 3 = 0").select("version_id", F.explode(F.array(F.lit("edit"), F.lit("add"))).alias("change"))
    return L.history(versions, changes)


@query("version_create", "SELECT dataset_name, count(*) AS n, max(v) AS last FROM (SELECT dataset_name, (major, minor, patch)::VARCHAR AS v FROM v_versions WHERE FALSE UNION ALL SELECT 'new data', '1.0.0') GROUP BY dataset_name")
def version_create(spark, d):
    """The first version of a dataset that had none."""
    made = L.create_version(view(spark, d, "v_versions"), table(spark, d, "labels"), 1, "new data")
    return made.where("dataset_name = 'new data'").groupBy("dataset_name").agg(F.count("*").alias("n"), F.max(F.concat_ws(".", *[F.col(c).cast("string") for c in ("major", "minor", "patch")])).alias("last"))


@query("version_lineage", "SELECT version_id, 'document' AS source_type, CAST(project_id AS VARCHAR) AS source_id FROM v_versions UNION ALL SELECT version_id, 'prompt', dataset_name FROM v_versions WHERE patch > 10")
def version_lineage(spark, d):
    rows = view(spark, d, "v_versions")
    return L.lineage(F.col("version_id"), rows, document=F.col("project_id"), prompt=F.when(F.col("patch") > 10, F.col("dataset_name")))


@query("project_from_path", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source END AS project FROM documents")
def project_from_path(spark, d):
    path = F.concat(F.when(F.col("doc_id") % 2 == 0, "/storage/uploads/").otherwise("/other/"), F.col("source"), F.lit("/f.txt"))
    return table(spark, d, "documents").select("doc_id", L.project_of(path).alias("project"))


@query("first_chunks", "SELECT source, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY doc_id) AS sample FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE k <= 10 GROUP BY source")
def first_chunks(spark, d):
    return L.first_chunks(table(spark, d, "documents").select("source", "doc_id", "text"), "source", "doc_id", "text")


@query("masked_logs", "SELECT doc_id, 'user=' || doc_id || ' token=*** end' AS line FROM labels")
def masked_logs(spark, d):
    i = F.col("doc_id").cast("string")
    return table(spark, d, "labels").select("doc_id", P.masked_log(F.concat(F.lit("user="), i, F.lit(" token=abc"), i, F.lit(" end"))).alias("line"))


@query("confidence_colours", "SELECT id, CASE WHEN confidence >= 0.8 THEN 'green' WHEN confidence >= 0.6 THEN 'orange' ELSE 'red' END AS colour FROM v_results")
def confidence_colours(spark, d):
    c = F.col("confidence")
    return view(spark, d, "v_results").select("id", F.when(c >= 0.8, "green").when(c >= 0.6, "orange").otherwise("red").alias("colour"))
