"""Queries over indexes, validation, samples in combination, merges and plug-ins."""

from pyspark.sql import functions as F

from ..operators import chunking as C
from ..operators import evaluation as E
from ..operators import library as L
from ..operators import models as M
from ..operators import quality as Q
from ..operators import records as R
from ..operators import sampling as S
from ..operators import search as X
from ..operators import taxonomy as T
from ..session import table
from .catalog import query
from .q_quality import BIAS, CONFIG, CONSISTENCY, DIFFICULTY, LEXICAL, r6
from .q_trees import H
from .views import view


@query("validated_results", "SELECT id FROM v_results WHERE job_id % 2 = 0")
def validated_results(spark, d):
    """Every other job is validated, some of the rest say no, some say nothing."""
    own = F.when(F.col("job_id") % 2 == 0, '{"is_validated": true}').when(F.col("job_id") % 3 == 0, '{"is_validated": false}').otherwise("{}")
    return view(spark, d, "v_results").where(X.validated(own)).select("id")


@query("index_update", """WITH x AS (SELECT 'category' AS kind, unnest(categories) AS term, id FROM v_results UNION ALL SELECT 'chunk', CAST(chunk_id AS VARCHAR), id FROM v_results)
SELECT kind, term, count(DISTINCT id) AS n FROM x GROUP BY ALL""")
def index_update(spark, d):
    """An index of half the results, then all results merged in: each entry is there once."""
    rows = view(spark, d, "v_results")
    index = X.updated_index(X.index_rows(rows.where("id % 2 = 0")), rows)
    return index.where("kind <> 'time'").groupBy("kind", "term").agg(F.count("*").alias("n"))


@query("combined_sample", f"""WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM documents),
a AS (SELECT source, doc_id FROM r WHERE n <= 4 OR k = 0 OR k = n - 1 OR list_contains(list_transform(range(1, 3), lambda i: CAST(round_even(i * (n - 1) / 3.0::DOUBLE, 0) AS BIGINT)), k)),
s AS (SELECT *, CASE WHEN k < n * 0.2::DOUBLE THEN 'begin' WHEN k < n * 0.8::DOUBLE THEN 'middle' ELSE 'end' END AS stratum FROM r),
b AS (SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source, stratum ORDER BY {H.format('doc_id', 42)}, doc_id) AS r FROM s) WHERE r <= 1),
u AS (SELECT source, doc_id, 0 AS f FROM (SELECT * FROM a UNION SELECT * FROM b)),
v AS (SELECT * FROM u UNION ALL SELECT source, doc_id, 1 FROM documents d WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.source = d.source AND u.doc_id = d.doc_id))
SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY f, {H.format('doc_id', 42)}, doc_id) AS k FROM v) WHERE k <= 12""")
def combined_sample(spark, d):
    """The union of a spread and a positional sample, filled up to twelve a source."""
    docs = table(spark, d, "documents").select("source", "doc_id")
    return S.combined([S.smart(docs, "source", "doc_id", 4), S.positional(docs, "source", "doc_id", "doc_id", 3)], docs, "source", "doc_id", 12)


@query("merged_metrics", "SELECT benchmark, model_name AS task, metric, arg_max(value, (ts, seq)) AS value FROM v_runs GROUP BY ALL")
def merged_metrics(spark, d):
    return E.merged_metrics(view(spark, d, "v_runs").withColumnRenamed("model_name", "task"))


@query("task_scores", """WITH c AS (SELECT 't' || (doc_id % 3) AS task, count(*) AS n, avg(CAST(prediction = label AS INT)) AS accuracy, count_if(prediction = 1 AND label = 1)::DOUBLE AS tp, count_if(prediction = 1 AND label = 0)::DOUBLE AS fp,
 count_if(prediction = 0 AND label = 1)::DOUBLE AS fn, count_if(prediction = 0 AND label = 0)::DOUBLE AS tn FROM v_pred GROUP BY 1)
SELECT task, n, round(accuracy, 6) AS accuracy, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1,
 round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0 END, 6) AS mcc FROM c""")
def task_scores(spark, d):
    """Accuracy, F1 and Matthews' correlation of several tasks at once."""
    pairs = view(spark, d, "v_pred").withColumn("task", F.concat(F.lit("t"), (F.col("doc_id") % 3).cast("string")))
    return r6(E.task_scores(pairs))


@query("task_inputs", "SELECT text || ' [SEP] ' || source AS text, doc_id AS label FROM documents")
def task_inputs(spark, d):
    rows = table(spark, d, "documents").select(F.col("text").alias("premise"), F.col("source").alias("hypothesis"), F.col("doc_id").alias("label"))
    return E.task_inputs(rows, "mnli")


@query("version_incremental", """WITH v AS (SELECT * FROM v_versions WHERE project_id = 1), n AS (SELECT dataset_name FROM v ORDER BY dataset_name LIMIT 1),
l AS (SELECT major, minor, patch, total_entries FROM v WHERE dataset_name = (SELECT dataset_name FROM n) ORDER BY major DESC, minor DESC, patch DESC, version_id DESC LIMIT 1)
SELECT CAST(major AS BIGINT) AS major, CAST(minor AS BIGINT) AS minor, CAST(patch + 1 AS BIGINT) AS patch, CAST(total_entries + (SELECT count(*) FROM labels) AS BIGINT) AS total_entries, 'incremental: added ' || (SELECT count(*) FROM labels) || ' entries' AS change FROM l""")
def version_incremental(spark, d):
    """A dataset's next version after entries came, and the change that says so."""
    versions = view(spark, d, "v_versions")
    name = versions.where("project_id = 1").agg(F.min("dataset_name")).first()[0]
    changes = versions.limit(0).select("version_id", F.lit("").alias("change"))
    after, told = L.record_incremental(versions, changes, table(spark, d, "labels"), 1, name)
    return after.join(told, "version_id").select(*[F.col(c).cast("long").alias(c) for c in ("major", "minor", "patch", "total_entries")], "change")


@query("quality_issues", f"""WITH {LEXICAL}, {BIAS}, {DIFFICULTY}, {CONSISTENCY},
m AS (SELECT 'diversity' AS metric, score, 0.6::DOUBLE AS threshold FROM div UNION ALL SELECT 'bias', score, 0.3::DOUBLE FROM bia UNION ALL SELECT 'difficulty', score, 0.7::DOUBLE FROM dif UNION ALL SELECT 'consistency', score, 0.8::DOUBLE FROM con2)
SELECT metric, format('{{}} score {{:.3f}} is {{}} the threshold {{:.2f}}', metric, score, CASE WHEN metric = 'bias' THEN 'above' ELSE 'below' END, threshold) AS issue FROM m WHERE CASE WHEN metric = 'bias' THEN score > threshold ELSE score < threshold END""")
def quality_issues(spark, d):
    return Q.issues(Q.report(view(spark, d, "v_qa"), CONFIG))


@query("taxonomy_find", "SELECT path FROM v_tax_b WHERE contains(lower(name), 'an') ORDER BY string_split(path, ' → ') LIMIT 1")
def taxonomy_find(spark, d):
    return T.find_by_name(view(spark, d, "v_tax_b"), "AN")


@query("taxonomy_below", "SELECT path, path = 'ASIA' OR starts_with(path, 'ASIA → ') AS below FROM v_tax_b")
def taxonomy_below(spark, d):
    return view(spark, d, "v_tax_b").select("path", T.belongs(F.col("path"), "ASIA").alias("below"))


@query("taxonomy_resolve", """WITH r AS (SELECT path FROM v_tax_a WHERE depth = 0 ORDER BY name LIMIT 1), c AS (SELECT path FROM v_tax_a WHERE depth = 1 AND starts_with(path, (SELECT path FROM r) || ' → ') ORDER BY name LIMIT 1 OFFSET 1) SELECT path FROM c""")
def taxonomy_resolve(spark, d):
    return T.resolve(view(spark, d, "v_tax_a"), "cat_0_1").select("path")


@query("bundle_counts", f"""WITH r AS (SELECT qa_id, CAST(({H.format('qa_id', 42)} // 65536) % 5 AS INT) AS fold, row_number() OVER (ORDER BY {H.format('qa_id', 42)}, qa_id) AS r, count(*) OVER () AS n FROM v_qa)
SELECT CASE WHEN r <= floor(n * 0.2::DOUBLE) THEN 'test' WHEN r <= floor(n * 0.2::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'train' END AS split, fold, count(*) AS n FROM r GROUP BY ALL""")
def bundle_counts(spark, d):
    """Rows of an evaluation bundle by split and fold."""
    return S.evaluation_bundle(view(spark, d, "v_qa").select("qa_id"), "qa_id").groupBy("split", "fold").agg(F.count("*").alias("n"))


@query("classified", "SELECT item_id AS chunk_id, c AS classifier, 'topic' AS category, regexp_extract(text, '[^\\n]*$') AS value, 1.0::DOUBLE AS confidence FROM benchmark, (SELECT unnest(['one', 'two']) AS c)")
def classified(spark, d):
    """Votes of two stand-in models, in the form the voting operators take."""
    return M.classify(table(spark, d, "benchmark"), {"one": M.echo, "two": M.echo}, F.col("text"), "item_id", "topic")


@query("hooked_entries", "SELECT doc_id, quality + 1 AS quality FROM labels WHERE quality = 1")
def hooked_entries(spark, d):
    """A step with one hook before it and one after it."""
    before, after = (lambda df: df.where("quality = 1")), (lambda df: df.withColumn("quality", F.col("quality") + 1))
    return L.hooks(table(spark, d, "labels").select("doc_id", "quality"), [before], [after])


@query("taxonomy_marked", "SELECT path, CASE WHEN depth = 0 THEN 'given' ELSE 'ai' END AS source FROM v_tax_b")
def taxonomy_marked(spark, d):
    tree = view(spark, d, "v_tax_b").select("path", F.when(F.col("depth") == 0, "given").alias("source"))
    return T.marked(tree, "ai")


@query("file_manifests", """WITH r AS (SELECT source, doc_id, n_chars, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 20 + 1 AS part FROM documents)
SELECT source AS document_id, CAST(part AS INT) AS part, (SELECT count(*) FROM documents d WHERE d.source = r.source) AS total_files, CAST((SELECT sum(n_chars) FROM documents d WHERE d.source = r.source) AS BIGINT) AS total_length,
 string_agg('f_' || doc_id || '.json', ',' ORDER BY doc_id) AS files FROM r GROUP BY source, part""")
def file_manifests(spark, d):
    """Manifests of 20 files a part."""
    files = table(spark, d, "documents").select(F.col("source").alias("document_id"), F.col("doc_id").alias("file_seq"), F.concat(F.lit("f_"), F.col("doc_id").cast("string"), F.lit(".json")).alias("file_path"), F.col("n_chars").alias("content_length"))
    return L.manifests(files, 20).withColumn("files", F.array_join("files", ","))


@query("split_manifests", """WITH s AS (SELECT doc_id, total_pages AS n, unnest(range(0, 1 + CAST(greatest(0, ceil((total_pages - 4) / 3.0)) AS INT))) AS k FROM v_pdf WHERE total_pages > 0),
f AS (SELECT doc_id, k, doc_id || '_split_' || lpad(CAST(k + 1 AS VARCHAR), 3, '0') || '_p' || (k * 3 + 1) || '-' || least(k * 3 + 4, n) || '.json' AS name, 500 * (least(k * 3 + 4, n) - k * 3) AS size FROM s)
SELECT doc_id AS document_id, CAST(1 AS INT) AS part, count(*) AS total_files, CAST(sum(size) AS BIGINT) AS total_length, string_agg(name, ',' ORDER BY k) AS files FROM f GROUP BY doc_id""")
def split_manifests(spark, d):
    """Manifests of the page splits of each document."""
    splits = C.page_splits(view(spark, d, "v_pdf"), "total_pages", 4, 1).withColumnRenamed("doc_id", "document_id").withColumn("content_length", (500 * (F.col("end_page") - F.col("start_page") + 1)).cast("long"))
    return L.manifests(L.split_manifests(splits)).withColumn("files", F.array_join("files", ","))


TREE_B = "t AS (SELECT 'World → ' || path AS path, path AS own, name, depth FROM v_tax_b WHERE string_split(path, ' → ')[1] IN (SELECT path FROM v_tax_b WHERE depth = 0))"


@query("taxonomy_resolve_all", f"""WITH {TREE_B}, o AS (SELECT path, row_number() OVER (ORDER BY name) - 1 AS i FROM t WHERE depth = 0),
p AS (SELECT t.path, o.i, row_number() OVER (PARTITION BY o.path ORDER BY t.name) - 1 AS j FROM t JOIN o ON starts_with(t.path, o.path || ' → ') WHERE depth = 1)
SELECT replace(own, ' → ', '.') AS wanted, path FROM t UNION ALL SELECT 'World . ' || replace(own, ' → ', ' . '), path FROM t UNION ALL SELECT 'World', 'World' UNION ALL SELECT 'cat_' || i, path FROM o UNION ALL SELECT i || '_' || j, path FROM p""")
def taxonomy_resolve_all(spark, d):
    """Index paths and dotted names, with and without the root, of all nodes; unknown ones resolve to nothing."""
    tree = view(spark, d, "v_tax_b").select("path", "name", "depth")
    tops = tree.where("depth = 0").select(F.col("path").alias("top"))
    tree = tree.join(tops, F.element_at(T.parts(F.col("path")), 1) == F.col("top")).select(F.concat(F.lit("World → "), "path").alias("path"), "name", (F.col("depth") + 1).alias("depth"))
    tree = tree.unionByName(spark.createDataFrame([("World", "World", 0)], "path string, name string, depth int"))
    below = F.expr("substring(path, 9)")
    names = tree.select(F.replace("path", F.lit(" → "), F.lit(" . ")).alias("wanted")).unionByName(tree.where("depth > 0").select(F.replace(below, F.lit(" → "), F.lit(".")).alias("wanted")))
    numbers = T.ids(tree, "x").select(F.replace(F.regexp_extract("node_id", r"^x\.0\.(.*)$", 1), F.lit("."), F.lit("_")).alias("i"))
    indexes = numbers.where("i <> ''").select(F.when(F.contains("i", F.lit("_")), F.col("i")).otherwise(F.concat(F.lit("cat_"), "i")).alias("wanted")).where("wanted RLIKE '^(cat_[0-9]+|[0-9]+_[0-9]+)$'")
    other = spark.createDataFrame([("cat_99",), ("No.Such",), (" ",), ("..",)], "wanted string")
    return T.resolve_all(tree, names.unionByName(indexes).unionByName(other))


@query("pack_questions", """SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_linenumber % 3 = 0 THEN 2 ELSE 1 END AS INT) AS template_id, CASE WHEN l_linenumber % 3 = 0 THEN 'What products does ' || source_entity || ' offer?' ELSE 'What are the key features of ' || source_entity || '?' END AS question,
 CASE WHEN l_linenumber % 3 = 0 THEN source_entity || ' offers products including ' || target_entity || '.' ELSE source_entity || ' includes features such as ' || target_entity || '.' END AS answer, confidence FROM v_relationships WHERE l_linenumber % 3 < 2""")
def pack_questions(spark, d):
    """The business pack over relations of companies, products and others."""
    k = F.col("l_linenumber") % 3
    rows = view(spark, d, "v_relationships").withColumns({"source_category": F.when(k == 0, "companies").when(k == 1, "products").otherwise("products"), "target_category": F.when(k == 0, "products").when(k == 1, "features").otherwise("companies")})
    return R.expand_templates(rows, R.template_pack(spark, "business"), 1000)


@query("suite_scores", "SELECT 'acceptable' AS task, count(*) AS n, round(avg(quality), 6) AS accuracy, round(2.0::DOUBLE * sum(quality) / (count(*) + sum(quality)), 6) AS f1, 0.0::DOUBLE AS mcc FROM labels")
def suite_scores(spark, d):
    """A suite of one task, and the stand-in model, whose reply is always yes."""

    class Labels:
        tasks = ("acceptable",)

        def load(self, spark, task):
            return table(spark, d, "labels").select(F.lit("acceptable").alias("text"), F.col("quality").cast("int").alias("label"))

        def parse(self, reply, task):
            return E.parse_answer(reply, "cola")

    return r6(E.evaluated(spark, Labels(), M.echo))


@query("chunk_token_bpe")
def chunk_token_bpe(spark, d):
    """Windows of a public byte-level vocabulary's tokens."""
    import public_tokenizers as P

    return C.chunk(table(spark, d, "documents").select("doc_id", "text"), C.Bpe(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, 512, 50))
