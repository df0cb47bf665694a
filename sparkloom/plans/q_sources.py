"""Queries that write files from the tables and read them back through the readers."""

from pyspark.sql import functions as F

from ..operators import chunking as C
from ..operators import library as L
from ..operators import quality as Q
from ..operators import records as R
from ..operators import sampling as S
from ..operators import search as H
from ..session import scratch, table
from ..sources import exports, paged
from ..sources import readers as I
from ..sources import writers as O
from .catalog import query
from .views import view


def files_of(df, by, path):
    """One text file below ``path``/``by``=... for each value, rows in order of their other columns' first."""
    # the second way to commit moves files in the tasks, not one by one on the driver
    df.repartition(by).sortWithinPartitions(by, "at").select(by, "value").write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(by).text(path)
    return path


def file_of(doc):
    """The name of a document's own file, in one of 1,024 folders."""
    return F.concat(F.lit("part="), F.pmod(F.xxhash64(doc), F.lit(1024)).cast("string"), F.lit("/doc="), doc.cast("string"), F.lit(".txt"))


PAGES = """
WITH f AS (SELECT doc_id // 25 AS file, string_agg(text, chr(10) ORDER BY doc_id) || chr(10) AS content FROM documents WHERE text IS NOT NULL GROUP BY 1),
n AS (SELECT file, CAST(ceil(strlen(content) / 4096.0) AS INT) AS n FROM f),
l AS (SELECT file, unnest(x) AS line, generate_subscripts(x, 1) AS k, len(x) AS last FROM (SELECT file, string_split(content, chr(10)) AS x FROM f)),
b AS (SELECT file, k, line || chr(10) AS line, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY file ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM l WHERE k < last),
p AS (SELECT file, k, line, CASE WHEN pos = 0 THEN 0 ELSE CAST((pos - 1) // 4096 AS INT) END AS page FROM b),
r AS (SELECT file, n, splits, CAST(s AS INT) AS split, CAST((s - 1) * 3 AS INT) AS first, CAST(least((s - 1) * 3 + 4, n) AS INT) AS stop
      FROM (SELECT file, n, splits, unnest(range(1, splits + 1)) AS s FROM (SELECT file, n, 1 + greatest(0, CAST(ceil((n - 4) / 3.0) AS INT)) AS splits FROM n))),
t AS (SELECT r.file, split, string_agg(line, '' ORDER BY k) FILTER (WHERE split > 1 AND page = first) AS overlap, string_agg(line, '' ORDER BY k) FILTER (WHERE split = 1 OR page > first) AS content
      FROM r JOIN p ON p.file = r.file AND p.page >= first AND p.page < stop GROUP BY ALL)
SELECT r.file, r.split, first + 1 AS first_page, stop AS last_page, CASE WHEN r.split > 1 THEN r.split - 1 END AS prev_split, CASE WHEN r.split < splits THEN r.split + 1 END AS next_split,
       CASE WHEN r.split > 1 THEN coalesce(overlap, '') END AS overlap, coalesce(content, '') AS content FROM r LEFT JOIN t ON t.file = r.file AND t.split = r.split"""


@query("document_pages", PAGES)
def document_pages(spark, d):
    """Page ranges of text files, 25 documents each, by the data source."""
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    path = files_of(docs.select(F.floor(F.col("doc_id") / 25).alias("file"), F.col("doc_id").alias("at"), F.col("text").alias("value")), "file", scratch(spark, "pages"))
    spark.dataSource.register(paged.document_source())
    found = spark.read.format(paged.FORMAT).option("path", path).option("pages_per_split", 4).option("overlap_pages", 1).option("page_bytes", 4096).load()
    return found.where("error IS NULL").select(F.regexp_extract("path", r"file=(\d+)", 1).cast("long").alias("file"), "split", "first_page", "last_page", "prev_split", "next_split", "overlap", "content")


PARSED = r"""SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN array_to_string(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), ' ') ELSE text END AS content
FROM documents WHERE regexp_matches(text, '[^\x20\x09-\x0D]') AND NOT regexp_matches(text, '[\f<>&]')"""


@query("parsed_documents", PARSED)
def parsed_documents(spark, d):
    """A file a document, plain, JSON with main_content or markup, each parsed by the handler that takes its path."""
    docs = table(spark, d, "documents").where(F.col("text").rlike(r"\S") & ~F.col("text").rlike(r"[\f<>&]"))
    of = F.element_at(F.array(*map(F.lit, ("plain", "parsed", "markup"))), (F.col("doc_id") % 3 + 1).cast("int"))
    words = F.array_join(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)), " ")
    content = F.when(of == "plain", F.col("text")).when(of == "parsed", F.to_json(F.struct(F.col("text").alias("main_content")))).otherwise(F.concat(F.lit("<html><script>var x = 1;</script><body><p>"), words, F.lit("</p></body></html>")))
    path = scratch(spark, "parsed")
    O.write_texts(docs.select(F.concat(F.lit("kind="), of, F.lit("/"), file_of(F.col("doc_id"))).alias("name"), content.alias("value")), path)

    def below(handler, kind):
        """A handler for the files of a folder."""
        handler.can_handle = lambda path: f"/kind={kind}/" in path
        return handler

    spark.dataSource.register(paged.document_source(below(paged.ParsedJson(), "parsed"), below(paged.Markup(), "markup"), below(paged.Whole(), "plain"), name="document_folders"))
    found = spark.read.format("document_folders").option("path", path).load()
    return found.select(F.regexp_extract("path", r"doc=(\d+)", 1).cast("long").alias("doc_id"), F.when(F.col("path").contains("/kind=plain/"), F.regexp_replace("content", r"\n\z", "")).otherwise(F.col("content")).alias("content"))


@query("parsed_files", "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'not { json ' || doc_id || chr(10) ELSE text END AS main_content FROM documents")
def parsed_files(spark, d):
    """main_content of files of JSON, a file a document; what is no JSON stays as it is."""
    doc = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("not { json "), F.col("doc_id").cast("string"))).otherwise(F.to_json(F.struct(F.col("text").alias("main_content"), "lang")))
    path = scratch(spark, "parsed")
    O.write_texts(table(spark, d, "documents").select(file_of(F.col("doc_id")).alias("name"), doc.alias("value")), path)
    return I.parsed_files(spark, f"{path}/part=*").select(F.regexp_extract("path", r"doc=(\d+)", 1).cast("long").alias("doc_id"), "main_content")


@query("entry_files", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(quality AS VARCHAR) AS quality FROM labels")
def entry_files(spark, d):
    """Entries of files of JSON lines with trailing commas, some files a list."""
    labels = table(spark, d, "labels")
    line = F.to_json(F.struct("doc_id", "quality"))
    path = scratch(spark, "entries")
    rows = labels.select((F.col("doc_id") % 8).alias("k"), F.col("doc_id").alias("at"), F.when(F.col("doc_id") % 8 < 4, F.concat(line, F.lit(","))).otherwise(line).alias("value"))
    found = I.json_entries(spark, f"{files_of(rows, 'k', path)}/*/*.txt")
    return found.select(F.get_json_object("entry", "$.doc_id").alias("doc_id"), F.get_json_object("entry", "$.quality").alias("quality"))


@query("first_file", "SELECT string_agg(doc_id || ':' || quality, chr(10) ORDER BY doc_id) || chr(10) AS value FROM labels WHERE quality = 0")
def first_file(spark, d):
    """The first of the files that a glob names."""
    rows = table(spark, d, "labels").select(F.col("quality").alias("k"), F.col("doc_id").alias("at"), F.concat_ws(":", "doc_id", "quality").alias("value"))
    return I.first_match(spark, f"{files_of(rows, 'k', scratch(spark, 'first'))}/k=*/*.txt").select("value")


@query("valid_chunks", "SELECT conv_id, turn FROM conversations WHERE conv_id % 5 <> 0 AND turn % 3 <> 0")
def valid_chunks(spark, d):
    """Chunks with an id and a text that is not blank."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("conv_id") % 5 != 0, F.col("conv_id")).alias("chunk_id"), F.when(F.col("turn") % 3 != 0, "text").when(F.col("turn") % 2 == 0, "  ").alias("chunk"))
    return I.valid_chunks(rows).select("conv_id", "turn")


@query("project_chunks", "SELECT l_orderkey AS document_id, l_linenumber AS chunk_index FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey % 4 = 1")
def project_chunks(spark, d):
    """Chunks of one project's documents."""
    chunks = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("chunk_index"), F.col("l_shipdate").alias("created_at"))
    docs = table(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"), (F.col("o_custkey") % 4).alias("project_id"))
    return I.project_chunks(chunks, docs, 1).select("document_id", "chunk_index")


@query("checked_results", "SELECT job_id, CAST((row_number() OVER (PARTITION BY job_id ORDER BY id) - 1) // 100 + 1 AS INT) AS page, job_id % 5 <> 0 AS valid FROM v_results QUALIFY (row_number() OVER (PARTITION BY job_id ORDER BY id) - 1) % 100 = 0")
def checked_results(spark, d):
    """Result files of jobs as written, some damaged since; the checksum tells."""
    pages = O.result_pages(view(spark, d, "v_results"))
    path = scratch(spark, "results")
    pages.withColumn("payload", F.when(F.col("job_id") % 5 == 0, F.concat("payload", F.lit(" "))).otherwise(F.col("payload"))).withColumn("job", F.col("job_id")).write.partitionBy("job").parquet(path)
    return I.checked_results(spark, path).select("job_id", "page", "valid")


@query("job_result_files", "SELECT job_id, count(*) AS n, round(avg(confidence), 6) AS avg_confidence FROM v_results WHERE job_id = 3 GROUP BY job_id")
def job_result_files(spark, d):
    """One job's results, found by its folder: the other files are not read."""
    path = scratch(spark, "jobs")
    view(spark, d, "v_results").select("id", "confidence", "job_id").write.partitionBy("job_id").json(path)
    return spark.read.json(path).where("job_id = 3").groupBy(F.col("job_id").cast("long").alias("job_id")).agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("avg_confidence"))


FORMS = "SELECT doc_id, quality, toxic, form FROM labels, (SELECT unnest(['parquet', 'jsonl', 'csv']) AS form)"


@query("dataset_formats", FORMS)
def dataset_formats(spark, d):
    """A dataset in each format, read back."""
    labels, root, out = table(spark, d, "labels").select("doc_id", "quality", "toxic"), scratch(spark, "formats"), None
    for form in ("parquet", "jsonl", "csv"):
        O.write_dataset(labels, f"{root}/{form}", form)
        read = spark.read.schema(labels.schema)
        back = read.parquet(f"{root}/{form}") if form == "parquet" else read.json(f"{root}/{form}") if form == "jsonl" else read.option("header", "true").csv(f"{root}/{form}")
        back = back.withColumn("form", F.lit(form))
        out = back if out is None else out.unionByName(back)
    return out


@query("bundle_files", "SELECT split, difficulty, count(*) AS n FROM (SELECT CASE WHEN doc_id % 10 = 0 THEN 'test' WHEN doc_id % 10 = 1 THEN 'validation' ELSE 'train' END AS split, CASE WHEN n_chars < 500 THEN 'easy' ELSE 'hard' END AS difficulty FROM documents) GROUP BY ALL")
def bundle_files(spark, d):
    """An evaluation bundle as folders by split and difficulty, counted from their names."""
    k = F.col("doc_id") % 10
    rows = table(spark, d, "documents").select("doc_id", "text", F.when(k == 0, "test").when(k == 1, "validation").otherwise("train").alias("split"), F.when(F.col("n_chars") < 500, "easy").otherwise("hard").alias("difficulty"))
    path = scratch(spark, "bundle")
    O.write_bundle(rows, path)
    return spark.read.parquet(path).groupBy("split", "difficulty").agg(F.count("*").alias("n"))


def read_export(spark, path):
    return spark.read.option("header", "true").option("escape", '"').option("multiLine", "true").csv(path).na.fill("")


@query("export_qa", "SELECT question AS \"Question\", answer AS \"Answer\", '' AS \"Context\", category AS \"QA_Type\", '' AS \"Confidence\" FROM v_qa")
def export_qa(spark, d):
    """Question and answer pairs as one CSV file with the fixed header."""
    path = scratch(spark, "export").removeprefix("file://")
    exports.export(view(spark, d, "v_qa").withColumnRenamed("category", "qa_type"), path, "qa_dataset.csv", "qa", ("qa_id",))
    return read_export(spark, exports.files(path, "qa_dataset.csv"))


@query("export_jobs", "SELECT CAST(o_orderkey AS VARCHAR) AS job_id, o_orderstatus AS status, '' AS created_at, '0' AS progress_percentage, CAST(o_custkey AS VARCHAR) AS project_id, '' AS taxonomy_id, o_orderpriority AS extraction_type, '' AS extraction_mode FROM orders")
def export_jobs(spark, d):
    """A summary of jobs in numbered files of about 5,000 rows, each with the header."""
    jobs = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("project_id"), F.col("o_orderpriority").alias("extraction_type"))
    path = scratch(spark, "export").removeprefix("file://")
    exports.export(jobs, path, "extraction_jobs_summary.csv", "jobs", ("job_id",), rows_per_file=5000)
    return read_export(spark, exports.files(path, "extraction_jobs_summary.csv"))


@query("export_datasets", "SELECT CAST(version_id AS VARCHAR) AS id, dataset_name AS name, '' AS format_type, '' AS created_at, '0' AS file_size, CAST(total_entries AS VARCHAR) AS record_count, '' AS chunking_strategy, '' AS embedding_model FROM v_versions")
def export_datasets(spark, d):
    rows = view(spark, d, "v_versions").select(F.col("version_id").alias("id"), F.col("dataset_name").alias("name"), F.col("total_entries").alias("record_count"))
    path = scratch(spark, "export").removeprefix("file://")
    exports.export(rows, path, "datasets_summary.csv", "datasets", ("id",))
    return read_export(spark, exports.files(path, "datasets_summary.csv"))


@query("export_taxonomies", "SELECT CAST(r_regionkey AS VARCHAR) AS \"ID\", r_name AS \"Name\", '' AS \"Project_ID\", CAST(count(n_nationkey) AS VARCHAR) AS \"Categories_Count\", '0.0' AS \"Confidence_Score\", 'Unknown' AS \"Created_At\" FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL")
def export_taxonomies(spark, d):
    rows = table(spark, d, "region").join(table(spark, d, "nation"), F.col("n_regionkey") == F.col("r_regionkey"), "left").groupBy(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")).agg(F.count("n_nationkey").alias("categories_count"))
    path = scratch(spark, "export").removeprefix("file://")
    exports.export(rows, path, "taxonomies_summary.csv", "taxonomies", ("id",))
    return read_export(spark, exports.files(path, "taxonomies_summary.csv"))


@query("export_benchmarks", """SELECT CAST(o_orderkey AS VARCHAR) AS job_id, o_orderstatus AS status, CASE WHEN o_orderkey % 5 = 0 THEN 'Unknown' ELSE 'm' || o_custkey END AS model_name, CASE WHEN o_orderkey % 3 = 0 THEN 'p, "q"' ELSE 'Unknown' END AS model_provider,
 CASE WHEN o_orderkey % 4 = 0 THEN 'N/A' ELSE CAST(o_custkey % 100 AS VARCHAR) END AS accuracy, 'N/A' AS f1_score FROM orders""")
def export_benchmarks(spark, d):
    """Benchmark results, nested as they are kept, as one flat CSV file."""
    c, k = F.col("o_custkey").cast("string"), F.col("o_orderkey")
    name, provider = F.when(k % 5 != 0, F.concat(F.lit("m"), c)), F.when(k % 3 == 0, 'p, "q"')
    info = F.to_json(F.struct(name.alias("name"), provider.alias("provider")))
    scores = F.when(k % 4 != 0, F.concat(F.lit('{"glue": {"accuracy": {"mean": '), (F.col("o_custkey") % 100).cast("string"), F.lit(', "std": 1}}, "other": {"f1": {"mean": 2}}}'))).otherwise("broken")
    rows = table(spark, d, "orders").select(k.alias("job_id"), F.col("o_orderstatus").alias("status"), info.alias("model_info"), scores.alias("performance_data"))
    path = scratch(spark, "export").removeprefix("file://")
    exports.export(exports.benchmark_summary(rows), path, "benchmark_results.csv", order=("job_id",))
    return read_export(spark, exports.files(path, "benchmark_results.csv"))


@query("export_filtered", "SELECT id, confidence FROM v_results WHERE confidence >= 0.8")
def export_filtered(spark, d):
    """Results of a search as one JSON list."""
    rows = view(spark, d, "v_results").where(H.predicate(min_confidence=0.8)).select("id", "confidence")
    path = scratch(spark, "export").removeprefix("file://")
    exports.export(rows, path, "results.json", order=("id",))
    return spark.read.schema("id long, confidence double").option("multiLine", "true").json(exports.files(path, "results.json"))


@query("relevant_categories", "SELECT event_id, NOT lower(trim(CASE WHEN event_id % 3 = 0 THEN ' None ' WHEN event_id % 3 = 1 THEN '' ELSE event_type END)) IN ('', 'none', 'null', 'false', '0') AS relevant FROM events")
def relevant_categories(spark, d):
    k = F.col("event_id") % 3
    return table(spark, d, "events").select("event_id", R.relevant(F.when(k == 0, " None ").when(k == 1, "").otherwise(F.col("event_type"))).alias("relevant"))


@query("folder_statistics", "SELECT k, CAST(1 AS BIGINT) AS files, round(sum(strlen(CAST(doc_id AS VARCHAR)) + 1) / 1024.0, 4) AS avg_kb FROM (SELECT doc_id, doc_id % 8 AS k FROM labels) GROUP BY k")
def folder_statistics(spark, d):
    """Files and their sizes by folder, from the listing."""
    rows = table(spark, d, "labels").select((F.col("doc_id") % 8).alias("k"), F.col("doc_id").alias("at"), F.col("doc_id").cast("string").alias("value"))
    path = files_of(rows, "k", scratch(spark, "folders"))
    return I.directory_statistics(spark, path).select(F.regexp_extract("directory", r"k=(\d+)", 1).cast("long").alias("k"), "files", F.round("avg_kb", 4).alias("avg_kb"))


@query("batch_lengths", "SELECT doc_id, CAST(length(text) AS BIGINT) AS n FROM documents")
def batch_lengths(spark, d):
    """A function of frames over all rows, a batch at a time."""
    return L.in_batches(table(spark, d, "documents").select("doc_id", "text"), lambda b: b.assign(n=b["text"].str.len())[["doc_id", "n"]], "doc_id long, n long")


@query("schema_check", "SELECT 'no column answer' AS problem, count(*) AS n FROM labels UNION ALL SELECT 'doc_id is bigint, not string', count(*) FROM labels")
def schema_check(spark, d):
    """What a table lacks of a result file's columns, and how many rows that concerns."""
    labels = table(spark, d, "labels")
    found = L.schema_problems(labels, {"doc_id": "string", "quality": "int", "answer": "string"})
    return labels.select(F.explode(F.array(*map(F.lit, found))).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


@query("headings_chunks", "SELECT doc_id, CAST(k AS INT) AS chunk_index, CASE WHEN k = 1 THEN 'start ' || doc_id ELSE '# Part ' || (k - 1) || chr(10) || 'text ' || doc_id END AS chunk FROM labels, (SELECT unnest([1, 2, 3]) AS k)")
def headings_chunks(spark, d):
    """Cuts before headings that a model proposed."""
    i = F.col("doc_id").cast("string")
    text = F.concat(F.lit("start "), i, *[F.concat(F.lit(f"\n# Part {k}\ntext "), i) for k in (1, 2)])
    rows = table(spark, d, "labels").select("doc_id", text.alias("text"), F.array(F.lit("# Part 1"), F.lit("# Part 2")).alias("heads"))
    return C.chunk(rows, C.Headings("heads")).drop("heads")


@query("custom_metric", "SELECT 'words' AS metric, 1.0::DOUBLE AS score, 0.5::DOUBLE AS threshold, TRUE AS passed")
def custom_metric(spark, d):
    """A metric of a caller's own beside the report's four."""
    Q.register_metric("words", lambda entries, config: entries.agg(F.avg((F.length("question") > 0).cast("double")).alias("score")))
    try:
        found = Q.report(view(spark, d, "v_qa"))
    finally:
        del Q.METRICS["words"]
    return found.where("metric = 'words'").select("metric", "score", "threshold", "passed")


@query("fold_files", "SELECT count(*) AS n, count(DISTINCT doc_id) AS docs FROM labels")
def fold_files(spark, d):
    """Five folds as folders: together they have every row once."""
    path = scratch(spark, "folds")
    O.write_bundle(S.folds(table(spark, d, "labels"), "doc_id", 5), path)
    return spark.read.parquet(path).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))
