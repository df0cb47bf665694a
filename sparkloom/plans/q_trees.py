"""Queries over taxonomies, samples, versions, jobs and templates."""

from pyspark.sql import functions as F

from ..functions.text import words
from ..operators import records as R
from ..operators import sampling as S
from ..operators import taxonomy as X
from ..session import table
from .catalog import query
from .q_chunking import w
from .q_quality import r6
from .views import view

A, B = "v_tax_a", "v_tax_b"
P = "string_split(path, ' → ')"


@query("taxonomy_levels", f"SELECT depth, count(*) AS n_nodes, round(avg(confidence_threshold), 6) AS avg_threshold FROM {B} GROUP BY depth")
def taxonomy_levels(spark, d):
    return r6(X.levels(view(spark, d, B)))


@query("taxonomy_analytics", f"SELECT count(*) AS total_nodes, max(depth) AS max_depth, round(avg(confidence_threshold), 6) AS avg_threshold FROM {B}")
def taxonomy_analytics(spark, d):
    return r6(X.analytics(view(spark, d, B)))


@query("taxonomy_paths", f"SELECT path, array_to_string({P}[1:len({P}) - 1], ' → ') AS parent FROM {B} WHERE depth > 0")
def taxonomy_paths(spark, d):
    return view(spark, d, B).where("depth > 0").select("path", X.parent(F.col("path")).alias("parent"))


@query("taxonomy_merge", f"""SELECT coalesce(a.path, b.path) AS path, coalesce(a.name, b.name) AS name, coalesce(a.depth, b.depth) AS depth, greatest(a.confidence_threshold, b.confidence_threshold) AS confidence_threshold,
CASE WHEN a.path IS NOT NULL AND b.path IS NOT NULL THEN 'merged' WHEN a.path IS NOT NULL THEN 'primary' ELSE 'secondary' END AS source FROM {A} a FULL JOIN {B} b ON a.path = b.path""")
def taxonomy_merge(spark, d):
    return X.merge(view(spark, d, A), view(spark, d, B)).select("path", "name", "depth", "confidence_threshold", "source")


@query("taxonomy_ancestors", f"SELECT DISTINCT array_to_string(p[1:k], ' → ') AS path FROM (SELECT {P} AS p, unnest(range(1, len({P}) + 1)) AS k FROM {B} WHERE name IN ('BUILDING', 'MACHINERY'))")
def taxonomy_ancestors(spark, d):
    return X.ancestors(view(spark, d, B).where("name IN ('BUILDING', 'MACHINERY')"))


@query("taxonomy_trim", f"""WITH r AS (SELECT *, array_to_string({P}[1:len({P}) - 1], ' → ') AS above, row_number() OVER (PARTITION BY array_to_string({P}[1:len({P}) - 1], ' → '), depth ORDER BY name) AS k FROM {B}),
x AS (SELECT path FROM r WHERE k > [2, 1, 3][depth + 1])
SELECT path, depth FROM {B} t WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.path = t.path OR starts_with(t.path, x.path || ' → '))""")
def taxonomy_trim(spark, d):
    return X.trim(view(spark, d, B), [2, 1, 3]).select("path", "depth")


@query("taxonomy_confidence", f"""SELECT greatest(round(sum(confidence_threshold * wt) / sum(wt), 3), 0.1::DOUBLE) AS confidence FROM
(SELECT confidence_threshold, greatest(1, 2 - (row_number() OVER (ORDER BY {P}) - 1) * 0.1::DOUBLE) AS wt FROM {B})""")
def taxonomy_confidence(spark, d):
    return X.confidence(view(spark, d, B))


@query("taxonomy_duplicates", f"SELECT name, count(*) AS n FROM {B} GROUP BY name HAVING count(*) > 1")
def taxonomy_duplicates(spark, d):
    return X.duplicates(view(spark, d, B))


@query("taxonomy_problems", f"SELECT path, 'no parent' AS problem FROM {B} t WHERE depth > 0 AND name <> 'BUILDING' AND NOT EXISTS (SELECT 1 FROM {B} p WHERE p.path = array_to_string(string_split(t.path, ' → ')[1:t.depth], ' → '))")
def taxonomy_problems(spark, d):
    return X.problems(view(spark, d, B)).where("NOT endswith(path, 'BUILDING')")


@query("taxonomy_ids", f"""WITH o AS (SELECT path, row_number() OVER (PARTITION BY array_to_string({P}[1:len({P}) - 1], ' → ') ORDER BY name) - 1 AS o FROM {A}),
s AS (SELECT path, k, array_to_string({P}[1:k], ' → ') AS at FROM (SELECT path, unnest(range(1, len({P}) + 1)) AS k FROM {A}))
SELECT s.path, 'p.' || string_agg(o, '.' ORDER BY k) AS node_id, 'p' || string_agg(o, '' ORDER BY k) AS legacy_id FROM s JOIN o ON s.at = o.path GROUP BY s.path""")
def taxonomy_ids(spark, d):
    return X.ids(view(spark, d, A), "p")


@query("taxonomy_selection", f"""WITH s AS (SELECT path, name LIKE '%A' AS sel FROM {A})
SELECT t.path, t.sel AS selected, coalesce(bool_or(b.sel), FALSE) AS has_selected_below, coalesce(bool_or(NOT b.sel), FALSE) AS has_unselected_below FROM s t LEFT JOIN s b ON starts_with(b.path, t.path || ' → ') GROUP BY ALL""")
def taxonomy_selection(spark, d):
    tree = view(spark, d, A)
    return X.selection(tree, tree.where("name LIKE '%A'"))


@query("taxonomy_children", f"SELECT p.path, coalesce(string_agg(c.name, ', ' ORDER BY c.name), '') AS children FROM {A} p LEFT JOIN {A} c ON c.depth = 1 AND starts_with(c.path, p.path || ' → ') WHERE p.depth = 0 GROUP BY p.path")
def taxonomy_children(spark, d):
    tree = view(spark, d, A)
    return X.children_of(tree, tree.where("depth = 0"))


@query("taxonomy_flat_names", f"SELECT string_agg(name, ', ' ORDER BY {P}) AS names FROM {B} WHERE depth < 2")
def taxonomy_flat_names(spark, d):
    return X.flatten_names(view(spark, d, B), 2)


@query("taxonomy_without", f"SELECT path FROM {B} WHERE NOT (path = 'AFRICA' OR starts_with(path, 'AFRICA → '))")
def taxonomy_without(spark, d):
    return X.without(view(spark, d, B), "AFRICA").select("path")


@query("taxonomy_search", f"SELECT path, FALSE AS pruned FROM {B} WHERE contains(lower(name), 'a') UNION ALL SELECT path, TRUE FROM {B} WHERE len(list_filter({P}, lambda x: NOT contains(lower(x), 'a'))) = 0")
def taxonomy_search(spark, d):
    tree = view(spark, d, B)
    return X.search(tree, "a").select("path", F.lit(False).alias("pruned")).unionByName(X.search(tree, "a", True).select("path", F.lit(True).alias("pruned")))


# -- samples ----------------------------------------------------------------------

H = "((({0} + {1}) * 2654435761) % 4294967296)"


@query("smart_sample", """WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT source, doc_id FROM r WHERE n <= 10 OR k = 0 OR k = n - 1 OR list_contains(list_transform(range(1, 9), lambda i: CAST(round_even(i * (n - 1) / 9.0::DOUBLE, 0) AS BIGINT)), k)""")
def smart_sample(spark, d):
    return S.smart(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", 10)


@query("positional_sample", f"""WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM documents),
s AS (SELECT *, CASE WHEN k < n * 0.2::DOUBLE THEN 'begin' WHEN k < n * 0.8::DOUBLE THEN 'middle' ELSE 'end' END AS stratum FROM r)
SELECT source, doc_id, stratum FROM (SELECT *, row_number() OVER (PARTITION BY source, stratum ORDER BY {H.format('doc_id', 42)}, doc_id) AS r FROM s) WHERE r <= 3""")
def positional_sample(spark, d):
    return S.positional(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", "doc_id", 9)


JACCARD = "len(list_intersect(ws[{0}], ws[{1}]))::DOUBLE / greatest(1, len(list_distinct(list_concat(ws[{0}], ws[{1}]))))"


@query("diversity_sample", f"""WITH r AS (SELECT source, doc_id, list_distinct({w('lower(text)')}) AS w, row_number() OVER (PARTITION BY source ORDER BY {H.format('doc_id', 42)}, doc_id) AS k FROM documents),
g AS (SELECT source, list(doc_id ORDER BY k) AS ids, list(w ORDER BY k) AS ws, count(*) AS n FROM r WHERE k <= 50 GROUP BY source),
c AS (SELECT source, ids, list_reduce(range(1, least(5, n)), lambda a, step: list_transform([list_sort(list_transform(list_filter(range(1, n + 1), lambda i: NOT list_contains(a.chosen, i)), lambda i: {{'v': a.near[i], 'i': i}}))[1].i],
 lambda b: {{'chosen': list_append(a.chosen, b), 'near': list_transform(range(1, n + 1), lambda i: greatest(a.near[i], {JACCARD.format('b', 'i')}))}})[1],
 {{'chosen': [CAST(1 AS BIGINT)], 'near': list_transform(range(1, n + 1), lambda i: {JACCARD.format('1', 'i')})}}).chosen AS chosen FROM g)
SELECT source, ids[chosen[k]] AS doc_id, CAST(k AS INT) AS pick FROM (SELECT *, unnest(range(1, len(chosen) + 1)) AS k FROM c)""")
def diversity_sample(spark, d):
    return S.diverse(table(spark, d, "documents").select("source", "doc_id", "text"), "source", "doc_id", "text", 5)


@query("split_rows", f"SELECT qa_id, category, CASE WHEN r <= floor(n * 0.2::DOUBLE) THEN 'test' WHEN r <= floor(n * 0.2::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY {H.format('qa_id', 42)}, qa_id) AS r, count(*) OVER (PARTITION BY category) AS n FROM v_qa)")
def split_rows(spark, d):
    return S.split(view(spark, d, "v_qa").select("qa_id", "category"), "qa_id", 0.2, 0.1, "category")


@query("split_counts", "SELECT CASE k WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split, CAST(CASE k WHEN 0 THEN floor(n * 0.2::DOUBLE) WHEN 1 THEN floor(n * 0.1::DOUBLE) ELSE n - floor(n * 0.2::DOUBLE) - floor(n * 0.1::DOUBLE) END AS BIGINT) AS n FROM (SELECT count(*) AS n FROM documents), (SELECT unnest([0, 1, 2]) AS k)")
def split_counts(spark, d):
    return S.split(table(spark, d, "documents").select("doc_id"), "doc_id").groupBy("split").agg(F.count("*").alias("n"))


@query("kfold_counts", f"SELECT CAST(({H.format('qa_id', 42)} // 65536) % 5 AS INT) AS fold, count(*) AS n FROM v_qa GROUP BY 1")
def kfold_counts(spark, d):
    return S.folds(view(spark, d, "v_qa"), "qa_id").groupBy("fold").agg(F.count("*").alias("n"))


@query("group_kfold_leaks", "SELECT CAST(0 AS BIGINT) AS leaking_groups")
def group_kfold_leaks(spark, d):
    """Categories that lie in more than one fold: none."""
    return S.folds(view(spark, d, "v_qa"), "qa_id", group="category").groupBy("category").agg(F.count_distinct("fold").alias("n")).agg(F.count_if(F.col("n") > 1).alias("leaking_groups"))


@query("adversarial_rows", f"SELECT qa_id, TRUE AS is_adversarial FROM v_qa ORDER BY {H.format('qa_id', 7)}, qa_id LIMIT CAST((SELECT floor(count(*) * 0.1::DOUBLE) FROM v_qa) AS BIGINT)")
def adversarial_rows(spark, d):
    return S.adversarial(view(spark, d, "v_qa"), "qa_id").select("qa_id", "is_adversarial")


@query("remaining_batches", "SELECT n_nationkey, CAST((row_number() OVER (ORDER BY n_nationkey) - 1) // 5 AS INT) AS batch FROM nation WHERE n_nationkey % 3 <> 0")
def remaining_batches(spark, d):
    nations = table(spark, d, "nation")
    return S.batches(nations, nations.where("n_nationkey % 3 = 0"), "n_nationkey", 5)


# -- versions, jobs, templates, metadata --------------------------------------------

V = "v_versions"
TOP = "array_to_string(list_transform([{0}.major, {0}.minor, {0}.patch], lambda x: CAST(x AS VARCHAR)), '.')"


@query("version_latest", f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY project_id, dataset_name ORDER BY major DESC, minor DESC, patch DESC, version_id DESC) AS k FROM {V}) SELECT project_id, dataset_name, {TOP.format('r')} AS version, version_id, total_entries FROM r WHERE k = 1")
def version_latest(spark, d):
    return R.latest_version(view(spark, d, V))


@query("version_next", f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY project_id, dataset_name ORDER BY major DESC, minor DESC, patch DESC) AS k FROM {V}) SELECT project_id, dataset_name, major || '.' || (minor + 1) || '.0' AS next_version FROM r WHERE k = 1")
def version_next(spark, d):
    return R.next_version(view(spark, d, V), "minor")


@query("version_compare", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY project_id, dataset_name ORDER BY major, minor, patch, version_id) AS k, row_number() OVER (PARTITION BY project_id, dataset_name ORDER BY major DESC, minor DESC, patch DESC, version_id DESC) AS l FROM {V})
SELECT a.project_id, a.dataset_name, {TOP.format('a')} AS first_version, {TOP.format('b')} AS second_version, b.total_entries - a.total_entries AS entry_delta, CASE WHEN (a.major, a.minor, a.patch) < (b.major, b.minor, b.patch) THEN 'older' ELSE 'same' END AS relation
FROM r a JOIN r b ON a.project_id = b.project_id AND a.dataset_name = b.dataset_name WHERE a.k = 1 AND b.l = 1""")
def version_compare(spark, d):
    return R.compare_versions(view(spark, d, V))


@query("version_rollback", f"SELECT version_id, (major, minor, patch) <= (1, 5, 7) AS is_active FROM {V}")
def version_rollback(spark, d):
    return R.rollback(view(spark, d, V), 1, 5, 7).select("version_id", "is_active")


J = "v_job_events"
LAST = f"l AS (SELECT job_id, arg_max(status, (ts, event_id)) AS status, max(ts) AS ts FROM {J} GROUP BY job_id)"


@query("job_status_counts", f"SELECT status, count(*) AS n FROM {J} GROUP BY status")
def job_status_counts(spark, d):
    return R.status_counts(view(spark, d, J))


@query("job_latest_status", f"WITH {LAST} SELECT * FROM l")
def job_latest_status(spark, d):
    return R.latest_status(view(spark, d, J))


@query("job_status_changes", f"SELECT event_id, job_id, previous, status FROM (SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS previous FROM {J}) WHERE previous IS DISTINCT FROM status")
def job_status_changes(spark, d):
    return R.status_changes(view(spark, d, J))


@query("active_jobs", f"WITH {LAST} SELECT job_id % 10 AS owner, CAST(count_if(status = 'running') AS BIGINT) AS running, count(*) AS jobs FROM l GROUP BY 1")
def active_jobs(spark, d):
    return R.active_jobs(view(spark, d, J))


@query("stuck_jobs", f"WITH {LAST} SELECT job_id FROM l WHERE status = 'running' AND ts <= TIMESTAMP '2024-01-31 12:00:00' - INTERVAL 60 SECOND")
def stuck_jobs(spark, d):
    return R.stuck(view(spark, d, J), "2024-01-31 12:00:00")


@query("finished_jobs", f"WITH {LAST} SELECT job_id FROM l WHERE status IN ('completed', 'failed', 'cancelled') AND ts < TIMESTAMP '2024-02-01 12:00:00' - INTERVAL 48 HOUR")
def finished_jobs(spark, d):
    return R.finished_before(view(spark, d, J), "2024-02-01 12:00:00")


@query("job_analytics", f"SELECT status, count(*) AS n, count(DISTINCT job_id) AS jobs, round(avg(epoch(date_trunc('second', nx))::BIGINT - epoch(date_trunc('second', ts))::BIGINT), 6) AS avg_seconds FROM (SELECT *, lead(ts) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS nx FROM {J}) GROUP BY status")
def job_analytics(spark, d):
    return r6(R.job_analytics(view(spark, d, J)))


@query("rate_limit_window", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts))::BIGINT RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS n_in_window FROM events")
def rate_limit_window(spark, d):
    return R.requests_in_window(table(spark, d, "events"), "user_id", "ts", 3600).select("event_id", "n_in_window")


# A few templates, as rows.
TEMPLATES = "(1, CAST(NULL AS {s}), 'What links {source} and {target}?', '{source} goes with {target}.'), (2, 'PROMO', 'Who offers {source}?', '{target}.'), (3, 'ECONOMY', 'Is {source} cheap?', 'Ask {target}.'), (4, NULL, 'Name a use of {source}.', 'See {target}.')"
EXPANDED = f"""t(template_id, category, q, a) AS (VALUES {TEMPLATES.replace('{s}', 'VARCHAR')}),
x AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY template_id) AS k FROM v_relationships JOIN t ON category IS NULL OR category = source_category),
e AS (SELECT l_orderkey, l_linenumber, template_id, replace(replace(q, '{{source}}', source_entity), '{{target}}', target_entity) AS question, replace(replace(a, '{{source}}', source_entity), '{{target}}', target_entity) AS answer, confidence FROM x WHERE k <= 2)"""


def expanded(spark, d):
    """Questions of relations; lines of one key, whose order the SQL leaves open, in that of the table, which its engine keeps as a rule."""
    templates = spark.sql(f"SELECT * FROM VALUES {TEMPLATES.replace('{s}', 'STRING')} AS t(template_id, category, question, answer)")
    return R.expand_templates(view(spark, d, "v_relationships", "lineitem"), templates, 2, ["place"])


@query("qa_templates", f"WITH {EXPANDED} SELECT l_orderkey, l_linenumber, template_id, question, answer, confidence FROM e")
def qa_templates(spark, d):
    return expanded(spark, d)


@query("qa_dedup", f"WITH {EXPANDED} SELECT question, answer, confidence, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY question, answer ORDER BY confidence DESC, l_orderkey, l_linenumber) AS k FROM e) WHERE k = 1")
def qa_dedup(spark, d):
    return R.dedup_answers(expanded(spark, d), ["l_orderkey", "l_linenumber"])


@query("qa_stats", f"WITH {EXPANDED} SELECT count(*) AS total, count(DISTINCT template_id) AS types, round(avg(confidence), 6) AS avg_confidence, count(DISTINCT question) AS unique_questions, count(DISTINCT answer) AS unique_answers FROM e")
def qa_stats(spark, d):
    return r6(R.answer_stats(expanded(spark, d)))


@query("page_metadata", """SELECT page_id, trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) AS title, nullif(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '') AS host FROM pages WHERE length(trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1))) >= 6""")
def page_metadata(spark, d):
    pages = table(spark, d, "pages")
    found = F.trim(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1))
    return pages.where(F.length(found) >= 6).select("page_id", found.alias("title"), F.nullif(F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1), F.lit("")).alias("host"))


def first_sql(patterns, condition, other="NULL", clean=None):
    """The first pattern's first match for which the condition holds, trimmed."""
    trim = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    found = [trim("regexp_extract(text, '(?im)" + p + "', 1)") for p in patterns]
    if clean:
        found = [trim(f"regexp_replace({x}, '{clean}', '', 'g')") for x in found]
    return "coalesce(" + ", ".join(f"CASE WHEN {condition.format(x)} THEN {x} END" for x in found) + f", {other})"


KEYS = "list_filter(list_transform({0}, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"
#: What some documents begin with, so that the patterns have something to find; the same text for both engines.
HEADS = """CASE doc_id % 6 WHEN 0 THEN concat('# Head of ', source, chr(10), 'Author: A. Writer (', source, ')', chr(10), 'Date: 3/14/2021', chr(10)) WHEN 1 THEN concat('Some title ', source, chr(10), '=====', chr(10), 'Written by: Bo, C-D', chr(10), 'Keywords: alpha; Beta, alpha', chr(10))
 WHEN 2 THEN concat('Title: The ', lang, chr(10), 'By: x', chr(10), 'published: 1-2-99', chr(10), '## Part One', chr(10), '**bold words** and **no**', chr(10)) WHEN 3 THEN concat('Short', chr(10), '-----', chr(10), 'seen 2020-02-03', chr(10), 'Keyword: one', chr(10)) ELSE '' END"""
# The patterns are spelled out here, not taken from the operator.
METADATA = f"""WITH d AS (SELECT doc_id, lang, n_chars, source, concat({HEADS}, text) AS text FROM documents),
k AS (SELECT *, {KEYS.format("regexp_split_to_array(regexp_extract(text, '(?im)Keywords?:[ \\t]*(.+)$', 1), '[;,]')")} AS named,
 list_filter({KEYS.format("list_concat(regexp_extract_all(text, '(?m)^#{1,3}\\s+(.+)$', 1), regexp_extract_all(text, '\\*\\*(.+?)\\*\\*', 1))")}, lambda x: length(x) > 3) AS marked FROM d),
f AS (SELECT *, list_filter(CASE WHEN len(named) > 0 THEN named ELSE marked END, lambda x: length(x) > 2) AS found,
 list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: length(x) > 10 AND NOT starts_with(x, '#')) AS parts FROM k),
g AS (SELECT *, array_to_string(parts[1:3], '. ') || '.' AS whole FROM f)
SELECT doc_id, lang, n_chars, {first_sql(["^#\\s+(.+)$", "^(.+)\\n={3,}", "^(.+)\\n-{3,}", "Title:\\s*(.+)$"], "length({0}) > 5", "'Doc ' || doc_id")} AS title,
 {first_sql(["Author:\\s*(.+)$", "By:\\s*(.+)$", "Written by:\\s*(.+)$", "^(.+)\\n.*(?:author|by|written)"], "length({0}) BETWEEN 3 AND 99", clean="[^\\p{L}\\p{N}_\\s,-]")} AS author,
 {first_sql(["Date:\\s*(\\d{1,2}[/-]\\d{1,2}[/-]\\d{2,4})", "Published:\\s*(\\d{1,2}[/-]\\d{1,2}[/-]\\d{2,4})", "(\\d{1,2}[/-]\\d{1,2}[/-]\\d{4})", "(\\d{4}-\\d{2}-\\d{2})"], "length({0}) > 0")} AS date,
 array_to_string((list_filter(found, lambda x, i: list_position(list_transform(found, lambda y: lower(y)), lower(x)) = i))[1:10], '|') AS keywords,
 CASE WHEN len(parts) = 0 THEN '' WHEN length(whole) > 200 THEN left(whole, 197) || '...' ELSE whole END AS summary, source AS origin FROM g"""


@query("document_metadata", METADATA)
def document_metadata(spark, d):
    """Metadata of every text by patterns; files are named after their source."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars", F.concat(F.expr(HEADS.replace("chr(", "char(")), "text").alias("text"), F.concat_ws("/", F.lit("data"), "source", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"))
    return R.metadata(docs, "text", "path").drop("text", "path").withColumn("keywords", F.array_join("keywords", "|"))


@query("entity_filter", f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter({w('text')}, lambda x: length(x) > 6))), ' ') AS entities FROM documents WHERE lower(trim(lang)) NOT IN ('none', 'null', 'false', '0', '')")
def entity_filter(spark, d):
    """Words of more than six characters, each once."""
    docs = table(spark, d, "documents").where(R.relevant(F.col("lang")))
    return docs.select("doc_id", F.array_join(F.array_sort(R.cleaned_entities(words(F.col("text")), 6)), " ").alias("entities"))
