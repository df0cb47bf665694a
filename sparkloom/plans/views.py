"""Views that give the tables the shapes the operators work on; one SQL text for both engines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..session import TABLES, placed, table

VIEWS = {
    "v_qa": """
SELECT conv_id * 1000 + turn AS qa_id, conv_id, turn, text AS question, answer, concat('topic_', conv_id % 7) AS category
FROM (SELECT conv_id, turn, role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer,
             lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations) c
WHERE role = 'user' AND next_role = 'assistant'""",
    "v_files": """
SELECT source AS document_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS file_seq, doc_id, text AS main_content,
       lag(right(text, 100)) OVER (PARTITION BY source ORDER BY doc_id) AS overlap_content FROM documents""",
    "v_pred": "SELECT doc_id, toxic AS prediction, quality AS label FROM labels",
    "v_votes": """
SELECT l.doc_id AS chunk_id, 'clf_a' AS classifier, 'grade' AS category, concat('v', quality) AS value, CAST(0.9 AS DOUBLE) AS confidence FROM labels l
UNION ALL SELECT l.doc_id, 'clf_b', 'grade', concat('v', 1 - toxic), CAST(0.6 AS DOUBLE) FROM labels l
UNION ALL SELECT l.doc_id, 'clf_c', 'grade', CASE WHEN d.n_chars > 1500 THEN 'v1' ELSE 'v0' END, CAST(0.5 AS DOUBLE) FROM labels l JOIN documents d ON d.doc_id = l.doc_id""",
    "v_tax_a": """
SELECT r_name AS path, CAST(NULL AS int) AS parent_key, r_name AS name, 0 AS depth, CAST(0.8 AS DOUBLE) AS confidence_threshold FROM region
UNION ALL SELECT concat(r_name, ' → ', n_name), CAST(n_regionkey AS int), n_name, 1, CAST(0.7 AS DOUBLE) FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "v_tax_b": """
SELECT r_name AS path, r_name AS name, 0 AS depth, CAST(0.6 AS DOUBLE) AS confidence_threshold FROM region WHERE r_regionkey < 3
UNION ALL SELECT DISTINCT concat(r_name, ' → ', n_name), n_name, 1, CAST(0.9 AS DOUBLE) FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0
UNION ALL SELECT DISTINCT concat(r_name, ' → ', n_name, ' → ', c_mktsegment), c_mktsegment, 2, CAST(0.5 AS DOUBLE)
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0""",
    "v_runs": """
SELECT o_orderkey AS seq, o_orderpriority AS model_name, concat('suite_', o_custkey % 3) AS benchmark, concat('m_', o_orderstatus) AS metric,
       o_orderdate AS ts, CAST(o_totalprice AS DOUBLE) AS value FROM orders""",
    "v_relationships": """
SELECT l_orderkey, l_linenumber, p_type AS source_category, p_brand AS target_category, p_name AS source_entity, s_name AS target_entity,
       CAST(l_discount AS DOUBLE) AS confidence FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey""",
    "v_versions": """
SELECT p_partkey AS version_id, p_partkey % 5 AS project_id, p_brand AS dataset_name, p_size % 4 AS major, p_size % 10 AS minor,
       p_partkey % 20 AS patch, p_size * 10 AS total_entries FROM part""",
    "v_job_events": """
SELECT event_id, user_id AS job_id, ts, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'completed'
       WHEN 'error' THEN 'failed' ELSE 'cancelled' END AS status FROM events""",
    "v_pdf": "SELECT doc_id, CAST(ceil(n_chars / CAST(500 AS DOUBLE)) AS int) AS total_pages FROM documents",
    "v_results": """
SELECT event_id AS id, user_id % 20 AS job_id, (user_id % 20) % 4 AS project_id, event_id % 500 AS chunk_id,
       {array}(event_type, concat('k', CAST({json}(props, '$.k') AS int) % 10)) AS categories,
       value / (value + 20) AS confidence, props AS extracted_data, ts AS created_at FROM events""",
}
SPARK = {"array": "array", "json": "get_json_object"}
DUCK = {"array": "list_value", "json": "json_extract_string"}


def _text(name: str, engine: dict[str, str]) -> str:
    out = VIEWS[name]
    for k, v in engine.items():
        out = out.replace("{" + k + "}", v)
    return out


def view(spark: SparkSession, sf_dir: str, name: str, by: str | None = None) -> DataFrame:
    """A view over the tables of a folder; one of a single SELECT may have ``place``, where rows of the table ``by`` are."""
    sql = _text(name, SPARK)
    source = re.compile(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b")
    tables = {t: table(spark, sf_dir, t) for t in {m[2] for m in source.finditer(sql)}}
    if by:
        sql, tables[by] = sql.replace("SELECT ", "SELECT place, ", 1), placed(tables[by])
    return spark.sql(source.sub(r"\1 {\2}", sql), **tables)


def oracle(sql: str) -> str:
    """``sql`` with the views it names as common table expressions."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    if not used:
        return sql
    head = ", ".join(f"{v} AS ({_text(v, DUCK)})" for v in used)
    return f"WITH {head}, {sql.strip()[5:]}" if sql.strip()[:5].upper() == "WITH " else f"WITH {head} {sql}"
