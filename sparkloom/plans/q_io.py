"""Queries over model replies, prompts and the shapes of files."""

from pyspark.sql import functions as F

from ..functions import replies as P
from ..operators import generation as G
from ..operators import models as M
from ..session import table
from ..sources import readers as I
from ..sources import writers as O
from .catalog import query
from .q_quality import r6
from .views import view


@query("reply_entries", """SELECT doc_id, CASE WHEN quality = 1 THEN 'q' || doc_id ELSE '' END AS question, CASE WHEN quality = 1 THEN 'a' || doc_id ELSE 'plain ' || doc_id END AS answer, 'because' AS reasoning, CASE WHEN quality = 1 THEN 0.5::DOUBLE ELSE 0 END AS confidence FROM labels""")
def reply_entries(spark, d):
    """Replies with thoughts, some in JSON in a fence, some in words."""
    i = F.col("doc_id").cast("string")
    reply = F.when(F.col("quality") == 1, F.concat(F.lit('<think>because</think>```json\n{"question": "q'), i, F.lit('", "answer": "a'), i, F.lit('", "confidence_score": 0.5}\n```'))).otherwise(F.concat(F.lit("<think>because</think>plain "), i))
    return table(spark, d, "labels").select("doc_id", P.entry(reply).alias("e")).select("doc_id", "e.*")


@query("reply_repair", "SELECT doc_id, '{\"id\": ' || doc_id || ', \"ok\": true}' AS json FROM labels")
def reply_repair(spark, d):
    """Replies with prose, bare keys and trailing commas."""
    broken = F.concat(F.lit("Sure! <think>{</think> {id: "), F.col("doc_id").cast("string"), F.lit(', "ok": true,} done'))
    return table(spark, d, "labels").select("doc_id", P.repair(broken).alias("json"))


@query("entry_normaliser", "SELECT conv_id, turn, CASE WHEN role = 'user' THEN text ELSE 'Do ' || turn END AS question, CASE WHEN role = 'user' THEN role ELSE text END AS answer FROM conversations")
def entry_normaliser(spark, d):
    rows = table(spark, d, "conversations")
    plain = F.to_json(F.struct(F.col("text").alias("question"), F.col("role").alias("answer")))
    instruct = F.to_json(F.struct(F.concat(F.lit("Do "), F.col("turn").cast("string")).alias("instruction"), F.col("text").alias("output")))
    return rows.select("conv_id", "turn", P.normalised_entry(F.when(F.col("role") == "user", plain).otherwise(instruct)).alias("e")).select("conv_id", "turn", "e.*")


@query("completeness", "SELECT event_id, CASE WHEN value > 100 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS completeness FROM events")
def completeness(spark, d):
    values = F.create_map(F.lit("type"), F.col("event_type"), F.lit("note"), F.when(F.col("value") > 100, "x").otherwise(" "))
    return table(spark, d, "events").select("event_id", P.completeness(values).alias("completeness"))


@query("json_path_chain", "SELECT event_id, coalesce(json_extract_string(props, '$.missing'), json_extract_string(props, '$.k')) AS k FROM events")
def json_path_chain(spark, d):
    return table(spark, d, "events").select("event_id", P.path_chain(F.col("props"), "$.missing", "$.k").alias("k"))


@query("prompt_render", "SELECT item_id, 'Ask about it.' || chr(10) || chr(10) || 'Content:' || chr(10) || text AS prompt FROM benchmark")
def prompt_render(spark, d):
    return table(spark, d, "benchmark").select("item_id", M.render("Ask about it.", {"chunk": F.col("text")}).alias("prompt"))


@query("model_replies", "SELECT item_id, regexp_extract(text, '[^\\n]*$') AS reply FROM benchmark")
def model_replies(spark, d):
    """Replies of the stand-in model."""
    return M.apply(table(spark, d, "benchmark"), F.col("text")).select("item_id", "reply")


@query("json_entries", "SELECT 'a' || doc_id AS entry FROM labels UNION ALL SELECT 'b' || doc_id FROM labels")
def json_entries(spark, d):
    """Two entries per text: a list, or lines with trailing commas."""
    i = F.col("doc_id").cast("string")
    objects = [F.concat(F.lit('{"v":"' + x), i, F.lit('"}')) for x in "ab"]
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("["), objects[0], F.lit(","), objects[1], F.lit("]"))).otherwise(F.concat(objects[0], F.lit(",\n"), objects[1], F.lit(",\n")))
    return I.entries(table(spark, d, "labels").select(text.alias("text"))).select(F.get_json_object("entry", "$.v").alias("entry"))


@query("chunk_shapes", "SELECT doc_id, CAST(k AS INT) AS ord, 'c' || k AS chunk FROM labels, (SELECT unnest([0, 1]) AS k)")
def chunk_shapes(spark, d):
    """Chunk files as a list or as an object with chunks."""
    text = F.when(F.col("doc_id") % 2 == 0, '["c0", "c1"]').otherwise('{"chunks": ["c0", "c1"]}')
    return I.chunks_of(table(spark, d, "labels").select("doc_id", text.alias("text")))


@query("json_rows", "SELECT doc_id, '{\"doc_id\":' || doc_id || ',\"quality\":' || quality || ',\"toxic\":' || toxic || '}' AS line FROM labels")
def json_rows(spark, d):
    labels = table(spark, d, "labels")
    return labels.select("doc_id", O.json_line(labels).alias("line"))


@query("result_pages", """WITH r AS (SELECT *, (row_number() OVER (PARTITION BY job_id ORDER BY id) - 1) // 100 + 1 AS page FROM v_results),
c AS (SELECT job_id, page, array_to_string(list_sort(list(DISTINCT c)), ',') AS categories FROM (SELECT job_id, page, unnest(categories) AS c FROM r) GROUP BY ALL)
SELECT job_id, CAST(page AS INT) AS page, count(*) AS n, round(avg(confidence), 6) AS avg_confidence, any_value(c.categories) AS categories, CAST(CASE WHEN page < max(page) OVER (PARTITION BY job_id) THEN page + 1 END AS INT) AS next_page FROM r JOIN c USING (job_id, page) GROUP BY job_id, page""")
def result_pages(spark, d):
    """Pages of results with their metadata; checksums hold."""
    pages = O.result_pages(view(spark, d, "v_results")).where(F.sha2("payload", 256) == F.col("checksum"))
    return r6(pages.select("job_id", "page", "n", "avg_confidence", F.array_join("categories", ",").alias("categories"), "next_page"))


@query("metrics_long", "SELECT 'quality' AS metric, avg(quality) AS value FROM labels UNION ALL SELECT 'toxic', avg(toxic) FROM labels")
def metrics_long(spark, d):
    return O.metrics_long(table(spark, d, "labels").agg(F.avg("quality").alias("quality"), F.avg("toxic").alias("toxic")))


@query("text_or_scan", "SELECT doc_id, length(text) > 500 AS is_text FROM documents")
def text_or_scan(spark, d):
    return table(spark, d, "documents").select("doc_id", I.is_text_document(F.col("text")).alias("is_text"))


MODE = "CASE conv_id % 7 WHEN 0 THEN 'qa' WHEN 1 THEN 'questions' WHEN 2 THEN 'answers' WHEN 3 THEN 'summary' WHEN 4 THEN 'instruction' WHEN 5 THEN 'extract' ELSE 'evaluation' END"
LEVEL = "CASE conv_id % 4 WHEN 0 THEN 'auto' WHEN 1 THEN 'advanced' WHEN 2 THEN '' END"


@query("mode_prompts", f"""WITH m AS (SELECT conv_id, turn, text, {MODE} AS mode, coalesce({LEVEL}, 'intermediate') AS level FROM conversations)
SELECT conv_id, turn, sha256('Content: ' || text || chr(10) || chr(10) || CASE mode WHEN 'qa' THEN 'Write 3 question and answer pairs about the content' WHEN 'questions' THEN 'Write 3 questions that the content answers' WHEN 'answers' THEN 'Write 3 statements that the content supports'
 WHEN 'summary' THEN 'Summarise the content in up to 3 summaries' WHEN 'instruction' THEN 'Write 3 instructions with the responses that the content gives' WHEN 'extract' THEN 'List up to 3 entities of the content with what it says about each' ELSE 'Write 3 test questions on the content, each with its expected answer' END
 || CASE WHEN level IN ('auto', '') THEN '' ELSE ' with ' || level || ' complexity level' END || '.' || chr(10) || chr(10) || 'Use only what the content says. Reply with a JSON list of objects.') AS digest FROM m""")
def mode_prompts(spark, d):
    """Prompts of all modes with the complexity that parameters ask for."""
    rows = G.parameters(table(spark, d, "conversations").withColumns({"mode": F.expr(MODE), "complexity_level": F.expr(LEVEL)}))
    return rows.select("conv_id", "turn", F.sha2(G.prompts(rows, F.col("mode"), "text"), 256).alias("digest"))


@query("taxonomy_focus", """SELECT doc_id, CASE WHEN lower(p) LIKE '%clinical%' OR lower(p) LIKE '%diagnosis%' THEN CASE WHEN lower(a) LIKE '%expert%' THEN 'clinical_diagnosis_expert' WHEN lower(a) LIKE '%novice%' OR lower(a) LIKE '%student%' THEN 'clinical_diagnosis_novice' ELSE 'clinical_diagnosis_general' END ELSE 'general' END AS focus
FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Clinical use' WHEN 1 THEN 'early DIAGNOSIS' ELSE 'teaching' END AS p, CASE doc_id % 4 WHEN 0 THEN 'Experts' WHEN 1 THEN 'students' WHEN 2 THEN 'a novice' ELSE 'all' END AS a FROM labels)""")
def taxonomy_focus(spark, d):
    k = F.col("doc_id")
    purpose = F.when(k % 3 == 0, "Clinical use").when(k % 3 == 1, "early DIAGNOSIS").otherwise("teaching")
    audience = F.when(k % 4 == 0, "Experts").when(k % 4 == 1, "students").when(k % 4 == 2, "a novice").otherwise("all")
    return table(spark, d, "labels").select("doc_id", G.focus(purpose, audience).alias("focus"))


def said(prompts):
    """A stand-in: entries whose names follow what a prompt asks for."""
    out = []
    for p in prompts:
        content = p.split("\n\n")[0].removeprefix("Content: ")
        n = len(content)
        if "summaries" in p:
            out.append('Sure: [{"title": "t%d", "summary": "s"}, {"title": "u", "summary": "",}]' % n)
        elif "entities" in p:
            out.append('{"entity": "e%d", "description": "d"}' % n)
        elif "plain" in p:
            out.append("no json %d" % n)
        else:
            out.append('[' + ', '.join('{"question": "q%d of %d", "answer": "a%d", "confidence_score": 0.5}' % (k, n, k) for k in range(4)) + ', {}]')
    return out


@query("generated_modes", """WITH c AS (SELECT item_id, length(text) AS n FROM benchmark WHERE text NOT LIKE '%' || chr(10) || chr(10) || '%')
SELECT item_id, 'qa' AS mode, CAST(k AS INT) AS entry_index, 'q' || k || ' of ' || n AS question, 'a' || k AS answer, 0.5::DOUBLE AS confidence FROM c, (SELECT unnest([0, 1, 2]) AS k)
UNION ALL SELECT item_id, 'summary', 0, 't' || n, 's', 0 FROM c UNION ALL SELECT item_id, 'summary', 1, 'u', '', 0 FROM c UNION ALL SELECT item_id, 'extract', 0, 'e' || n, 'd', 0 FROM c UNION ALL SELECT item_id, 'custom', 0, '', 'no json ' || (n + 6), 0 FROM c""")
def generated_modes(spark, d):
    """Entries of four modes by a stand-in model: lists, broken lists, one object, plain text."""
    chunks = table(spark, d, "benchmark").where(~F.contains("text", F.lit("\n\n"))).select("item_id", F.col("text").alias("chunk"))
    out = None
    for mode in ("qa", "summary", "extract", "custom"):
        one = G.generated(chunks, mode, said, template=F.lit("plain {chunk}") if mode == "custom" else None)
        out = one if out is None else out.unionByName(one)
    return out.drop("reasoning")


@query("multi_stage_votes", """WITH v AS (SELECT doc_id AS chunk_id, CASE WHEN doc_id % 3 = 0 THEN ['x', 'y', 'y'] WHEN doc_id % 3 = 1 THEN ['x', 'x', 'x'] ELSE ['x', 'z', 'x'] END AS v FROM labels)
SELECT chunk_id, 'topic' AS category, CASE WHEN chunk_id % 3 = 0 THEN 'y' ELSE 'x' END AS value, CASE WHEN chunk_id % 3 = 1 THEN 3.0::DOUBLE ELSE 2.0 END AS weight, CASE WHEN chunk_id % 3 = 1 THEN 1.0::DOUBLE ELSE round(2 / 3.0::DOUBLE, 6) END AS agreement FROM v""")
def multi_stage_votes(spark, d):
    """Two models and a second look by the first: for a third of the chunks it joins the other, for a third it stays."""
    chunks = table(spark, d, "labels").select(F.col("doc_id").alias("chunk_id"), (F.col("doc_id") % 3).cast("string").alias("k"))
    one = lambda prompts: ["y" if p.startswith("check 0") else "x" for p in prompts]
    two = lambda prompts: [{"0": "y", "1": "x", "2": "z"}[p[-1]] for p in prompts]
    found = G.multi_stage(chunks, {"one": one, "two": two}, "one", F.col("k"), F.concat(F.lit("check "), "k", F.lit(" "), "best"), category="topic")
    return r6(found)
