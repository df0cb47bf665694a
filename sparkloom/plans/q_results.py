"""Queries over extraction results: search, statistics, joins."""

from pyspark.sql import functions as F

from ..operators import search as S
from ..operators import stats as T
from ..session import table
from .catalog import query
from .q_quality import r6
from .views import view

R = "v_results"


@query("search_fulltext", f"""SELECT id, round(confidence, 6) AS confidence, (SELECT count(*) FROM {R} WHERE (extracted_data ILIKE '%7%' OR len(list_filter(categories, lambda c: c ILIKE '%7%')) > 0) AND confidence >= 0.3) AS total FROM {R}
WHERE (extracted_data ILIKE '%7%' OR len(list_filter(categories, lambda c: c ILIKE '%7%')) > 0) AND confidence >= 0.3 ORDER BY v_results.confidence DESC, created_at DESC, id LIMIT 50 OFFSET 10""")
def search_fulltext(spark, d):
    found = view(spark, d, R).where(S.predicate("7", min_confidence=0.3))
    return r6(S.with_total(found, 50, 10).select("id", "confidence", "total"))


@query("search_categories_all", f"SELECT id, round(confidence, 6) AS confidence FROM {R} WHERE len(list_filter(categories, lambda c: c ILIKE '%view%')) > 0 AND len(list_filter(categories, lambda c: c ILIKE '%k3%')) > 0 AND created_at >= '2024-01-05' AND created_at <= '2024-01-20'")
def search_categories_all(spark, d):
    return r6(view(spark, d, R).where(S.predicate(categories=["view", "k3"], match_all=True, date_from="2024-01-05", date_to="2024-01-20")).select("id", "confidence"))


@query("search_categories_any", f"SELECT id FROM {R} WHERE len(list_filter(categories, lambda c: c ILIKE '%view%' OR c ILIKE '%k3%')) > 0")
def search_categories_any(spark, d):
    return view(spark, d, R).where(S.predicate(categories=["view", "k3"])).select("id")


@query("search_chunk", f"SELECT id, chunk_id FROM {R} WHERE chunk_id = 42 AND confidence >= 0.2")
def search_chunk(spark, d):
    return view(spark, d, R).where(S.predicate(chunk_id=42, min_confidence=0.2)).select("id", "chunk_id")


@query("search_page_meta", f"SELECT count(*) AS total, CAST(3 AS INT) AS page, CAST(ceil(count(*) / 50.0) AS BIGINT) AS total_pages, 3 < ceil(count(*) / 50.0) AS has_next, TRUE AS has_prev FROM {R} WHERE confidence >= 0.7")
def search_page_meta(spark, d):
    return S.page_info(view(spark, d, R).where(S.predicate(min_confidence=0.7)), 3, 50)


@query("search_suggestions", f"""SELECT suggestion FROM (SELECT unnest(categories) AS suggestion FROM {R} UNION SELECT x FROM (SELECT unnest(regexp_split_to_array(lower(extracted_data), '[^a-z0-9]+')) AS x FROM {R}) WHERE length(x) > 3)
WHERE suggestion ILIKE 'k%' ORDER BY suggestion LIMIT 10""")
def search_suggestions(spark, d):
    return S.suggestions(view(spark, d, R), "k")


@query("search_postings_and", """SELECT doc_id FROM documents WHERE len(list_intersect(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), ['then', 'there'])) = 0
 AND len(list_intersect(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), ['que', 'los'])) = 2""")
def search_postings_and(spark, d):
    """Texts with both words; a word the index does not have does not count."""
    index = S.postings(table(spark, d, "documents"))
    found = S.match_all_terms(index, ["que", "los", "qqqqqq"])
    return found.join(S.match_all_terms(index, ["then"]).union(S.match_all_terms(index, ["there"])), "doc_id", "left_anti")


@query("search_category_index", f"SELECT id FROM {R} WHERE (list_contains(categories, 'error') OR chunk_id = 7) AND created_at BETWEEN '2024-01-03' AND '2024-01-09'")
def search_category_index(spark, d):
    return S.category_index(view(spark, d, R), ["error"], 7, "2024-01-03", "2024-01-09")


@query("result_page_exact", f"SELECT id FROM {R} WHERE confidence >= 0.5 AND list_contains(categories, 'view') ORDER BY confidence DESC, created_at DESC, id LIMIT 20 OFFSET 20")
def result_page_exact(spark, d):
    """The second page of results that have a category."""
    return S.page(view(spark, d, R).where((F.col("confidence") >= 0.5) & F.array_contains("categories", "view")), 20, 20).select("id")


@query("retention_time", f"SELECT count(*) AS total, CAST(count_if(created_at < TIMESTAMP '2024-02-01' - INTERVAL 20 DAY) AS BIGINT) AS candidates, CAST(sum(CASE WHEN created_at < TIMESTAMP '2024-02-01' - INTERVAL 20 DAY THEN length(extracted_data) + 100 END) AS BIGINT) AS bytes_freed, round(count_if(created_at < TIMESTAMP '2024-02-01' - INTERVAL 20 DAY) * 100.0::DOUBLE / count(*), 6) AS pct FROM {R}")
def retention_time(spark, d):
    return r6(S.retention(view(spark, d, R), "2024-02-01", 20))


@query("retention_budget", f"""WITH o AS (SELECT job_id, list(struct_pack(id := id, n := length(extracted_data) + 100) ORDER BY created_at, id) AS x FROM {R} GROUP BY job_id),
f AS (SELECT job_id, list_reduce(x, lambda a, y: {{'used': CASE WHEN a.used + y.n <= 20000 THEN a.used + y.n ELSE a.used END, 'kept': list_append(a.kept, {{'id': y.id, 'kept': a.used + y.n <= 20000}})}}, {{'used': CAST(0 AS BIGINT), 'kept': []::STRUCT(id BIGINT, kept BOOLEAN)[]}}) AS r FROM o)
SELECT job_id, k.id AS id, k.kept AS kept FROM (SELECT job_id, unnest(r.kept) AS k FROM f)""")
def retention_budget(spark, d):
    return S.budget_oldest_first(view(spark, d, R), 20_000)


@query("stats_overall", f"SELECT count(*) AS total, count(DISTINCT job_id) AS jobs, count(DISTINCT chunk_id) AS chunks, round(avg(confidence), 6) AS avg_confidence, round(min(confidence), 6) AS min_confidence, round(max(confidence), 6) AS max_confidence, min(created_at) AS oldest, max(created_at) AS newest FROM {R}")
def stats_overall(spark, d):
    return r6(T.overall(view(spark, d, R)))


@query("stats_category", f"SELECT category, count(*) AS n, round(avg(confidence), 6) AS avg_confidence FROM (SELECT unnest(categories) AS category, confidence FROM {R}) GROUP BY category")
def stats_category(spark, d):
    return r6(T.by_category(view(spark, d, R)))


@query("stats_chunk", f"SELECT chunk_id, count(*) AS n, round(avg(confidence), 6) AS avg_confidence, min(created_at) AS oldest, max(created_at) AS newest FROM {R} GROUP BY chunk_id ORDER BY oldest DESC, chunk_id LIMIT 100")
def stats_chunk(spark, d):
    return r6(T.by_chunk(view(spark, d, R)).orderBy(F.col("oldest").desc(), "chunk_id").limit(100))


@query("stats_time_bucket", f"SELECT strftime(created_at, '%Y-%m-%d %H:00') AS bucket, count(*) AS n, round(avg(confidence), 6) AS avg_confidence FROM {R} GROUP BY 1")
def stats_time_bucket(spark, d):
    return r6(T.by_time(view(spark, d, R), "hour"))


@query("stats_bands", f"SELECT CASE WHEN confidence >= 0.9 THEN 'high' WHEN confidence >= 0.7 THEN 'medium' WHEN confidence >= 0.5 THEN 'low' ELSE 'very_low' END AS band, count(*) AS n, avg(len(categories)) AS avg_categories, CAST(max(len(categories)) AS INT) AS max_categories FROM {R} GROUP BY 1")
def stats_bands(spark, d):
    return T.by_band(view(spark, d, R))


@query("stats_size", f"SELECT project_id, count(*) AS n, CAST(sum(length(extracted_data)) + count(*) * 100 AS BIGINT) AS bytes FROM {R} GROUP BY project_id")
def stats_size(spark, d):
    return T.storage(view(spark, d, R), "project_id")


@query("stats_partial_final", f"SELECT job_id, count(*) AS n, round(avg(confidence), 6) AS avg_confidence, min(created_at) AS oldest, max(created_at) AS newest, (SELECT array_to_string(list_sort(list(DISTINCT c)), ',') FROM (SELECT job_id AS j, unnest(categories) AS c FROM {R}) WHERE j = r.job_id) AS categories FROM {R} r GROUP BY job_id")
def stats_partial_final(spark, d):
    return r6(T.merged(T.partials(view(spark, d, R)))).withColumn("n", F.col("n").cast("long"))


@query("result_chunks_time", f"SELECT h AS chunk_name, CAST((r - 1) // 10 AS BIGINT) AS part, count(*) AS n, min(created_at) AS min_ts FROM (SELECT strftime(created_at, '%Y%m%d_%H') AS h, created_at, row_number() OVER (PARTITION BY strftime(created_at, '%Y%m%d_%H') ORDER BY created_at, id) AS r FROM {R}) GROUP BY ALL")
def result_chunks_time(spark, d):
    return T.time_chunks(view(spark, d, R), 10)


@query("result_chunks_size", f"SELECT job_id, 'size_chunk_' || ((r - 1) // 100) AS chunk_name, count(*) AS n, round(avg(confidence), 6) AS avg_confidence, min(id) AS first_id FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY id) AS r FROM {R}) GROUP BY ALL")
def result_chunks_size(spark, d):
    return r6(T.size_chunks(view(spark, d, R), "job_id"))


@query("join_inner_documents", "SELECT d.doc_id, source, quality, n_chars FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE source = 'src3'")
def join_inner_documents(spark, d):
    docs = table(spark, d, "documents").where("source = 'src3'").select("doc_id", "source", "n_chars")
    return docs.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")


@query("join_three_way", "SELECT r_name, n_name, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def join_three_way(spark, d):
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name", "n_name", "c_mktsegment").agg(F.count("*").alias("n"))


@query("join_left_status", "SELECT o_orderstatus, count(*) AS orders, count(l_orderkey) AS lines FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity > 45) ON o_orderkey = l_orderkey GROUP BY o_orderstatus")
def join_left_status(spark, d):
    lines = table(spark, d, "lineitem").where("l_quantity > 45").select("l_orderkey")
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_orderstatus").agg(F.count("*").alias("orders"), F.count("l_orderkey").alias("lines"))


@query("join_left_fanout", "SELECT v.project_id, count(*) AS rows_out FROM v_versions v LEFT JOIN (SELECT DISTINCT project_id, major FROM v_versions) p ON v.project_id = p.project_id GROUP BY v.project_id")
def join_left_fanout(spark, d):
    """Versions meet all parameter rows of their project: a join that multiplies rows."""
    versions = view(spark, d, "v_versions")
    parameters = versions.select("project_id", "major").distinct()
    return versions.select("project_id").join(parameters, "project_id", "left").groupBy("project_id").agg(F.count("*").alias("rows_out"))


@query("join_semi_project", f"SELECT id FROM {R} r WHERE EXISTS (SELECT 1 FROM {R} j WHERE j.job_id = r.job_id AND j.confidence > 0.958) AND project_id = 1")
def join_semi_project(spark, d):
    results = view(spark, d, R)
    return results.where("project_id = 1").join(results.where("confidence > 0.958").select("job_id").distinct(), "job_id", "left_semi").select("id")


@query("join_anti_cascade", f"SELECT id, chunk_id FROM {R} WHERE job_id NOT IN (SELECT job_id FROM {R} WHERE project_id = 2)")
def join_anti_cascade(spark, d):
    """What is left after a project's jobs and their results are deleted."""
    results = view(spark, d, R)
    return results.join(results.where("project_id = 2").select("job_id").distinct(), "job_id", "left_anti").select("id", "chunk_id")


@query("join_lookup_fallback", "SELECT l_orderkey, l_linenumber, coalesce(p_name, CAST(l_partkey AS VARCHAR)) AS part FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size < 25) ON l_partkey = p_partkey")
def join_lookup_fallback(spark, d):
    parts = table(spark, d, "part").where("p_size < 25").select("p_partkey", "p_name")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left").select("l_orderkey", "l_linenumber", F.coalesce("p_name", F.col("l_partkey").cast("string")).alias("part"))


@query("project_counts", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS n_finished FROM customer")
def project_counts(spark, d):
    """Counts per owner that are zero where there are none, from one aggregate."""
    orders = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.count_if(F.col("o_orderstatus") == "F").alias("n_finished"))
    joined = table(spark, d, "customer").select("c_custkey").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), F.coalesce("n_finished", F.lit(0)).alias("n_finished"))


@query("ema_runtime", """WITH RECURSIVE e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
w AS (SELECT user_id, k, value AS ema FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.k, 0.1::DOUBLE * e.value + 0.9::DOUBLE * w.ema FROM w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1)
SELECT user_id, round(arg_max(ema, k), 6) AS ema FROM w GROUP BY user_id""")
def ema_runtime(spark, d):
    return r6(T.moving_average(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value"))


@query("operation_metrics", "SELECT event_type AS op, count(*) AS n, CAST(count_if(value > 300) AS BIGINT) AS errors, max(value) AS max_value, min(value) AS min_value, round(avg(value), 6) AS avg_value, CASE WHEN count_if(value > 300)::DOUBLE / count(*) > 0.1 THEN 'critical' WHEN count_if(value > 300)::DOUBLE / count(*) > 0.05 THEN 'warning' ELSE 'healthy' END AS health FROM events GROUP BY event_type")
def operation_metrics(spark, d):
    out = T.operation_metrics(table(spark, d, "events"), "event_type", "value", F.col("value") > 300)
    return out.withColumn("avg_value", F.round("avg_value", 6))


@query("results_csv", f"SELECT id, array_to_string(categories, ', ') AS categories FROM {R}")
def results_csv(spark, d):
    """Rows as the CSV export writes them."""
    return view(spark, d, R).select("id", F.concat_ws(", ", "categories").alias("categories"))
