"""Queries over chunkers and text functions."""

from pyspark.sql import functions as F

from ..functions import content as V
from ..functions import text as X
from ..operators import chunking as C
from ..session import table
from .catalog import query
from .views import view

WORDS = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda t: t <> '')"
STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


def w(c: str) -> str:
    return WORDS.format(c)


def sentences(c: str) -> str:
    return f"len(list_filter(regexp_split_to_array(trim({c}), '[.!?]+'), lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g')) <> ''))"


def syllables(c: str) -> str:
    clean = f"list_filter(list_transform({w(f'lower({c})')}, lambda x: regexp_replace(x, '[^\\p{{L}}\\p{{N}}_]', '', 'g')), lambda x: x <> '')"
    n = "len(regexp_extract_all(x, '[aeiouy]+'))"
    return f"coalesce(list_sum(list_transform({clean}, lambda x: greatest(1, {n} - CASE WHEN x LIKE '%e' AND {n} > 1 THEN 1 ELSE 0 END))), 0)"


def flesch(c: str) -> str:
    n, s = f"len({w(c)})", sentences(c)
    return f"CASE WHEN {n} = 0 OR {s} = 0 THEN 50.0::DOUBLE ELSE greatest(0, least(100, 206.835::DOUBLE - 1.015::DOUBLE * ({n}::DOUBLE / {s}) - 84.6::DOUBLE * ({syllables(c)}::DOUBLE / {n}))) END"


def complexity(c: str) -> str:
    n = f"len({w(c)})"
    length = f"list_sum(list_transform({w(c)}, lambda x: length(x)))::DOUBLE / {n}"
    return (
        f"CASE WHEN {n} > 0 THEN greatest(0, least(1, ({length} - 4) / 6.0::DOUBLE * 0.4::DOUBLE + len(list_distinct({w(c)}))::DOUBLE / {n} * 0.3::DOUBLE"
        f" + ({n}::DOUBLE / greatest(1, {sentences(c)}) - 10) / 20.0::DOUBLE * 0.3::DOUBLE)) END"
    )


def chunks_sql(array: str, columns: str, source: str = "documents") -> str:
    """Rows of an array of chunks with their numbers."""
    return f"SELECT {columns} FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS k FROM (SELECT *, {array} AS parts FROM {source})) WHERE len(parts) > 0"


@query("chunk_character", chunks_sql(
    f"CASE WHEN {STRIP.format('text')} = '' THEN [] ELSE list_transform(range(0, length(text), 462), lambda i: substring(text, i + 1, 512)) END",
    "doc_id, CAST(k AS INT) AS chunk_index, CAST(length(parts[k]) AS INT) AS chunk_len, substring(parts[k], 1, 200) AS preview"))
def chunk_character(spark, d):
    return C.preview(C.chunk(table(spark, d, "documents").select("doc_id", "text"), C.Character(512, 50)))


@query("chunk_delimiter", chunks_sql(
    f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {STRIP.format('x')}), lambda x: x <> '')", "doc_id, CAST(k AS INT) AS chunk_index, parts[k] AS chunk"))
def chunk_delimiter(spark, d):
    return C.chunk(table(spark, d, "documents").select("doc_id", "text"), C.Delimiter("\n"))


@query("chunk_token_ws", chunks_sql(
    f"list_transform(range(0, len({w('text')}), 56), lambda i: array_to_string(({w('text')})[i + 1:i + 64], ' '))",
    f"doc_id, CAST(k AS INT) AS chunk_index, CAST(len({w('parts[k]')}) AS INT) AS n_tokens, parts[k] AS chunk"))
def chunk_token_ws(spark, d):
    out = C.chunk(table(spark, d, "documents").select("doc_id", "text"), C.Token(64, 8))
    return out.withColumn("n_tokens", F.size(X.words(F.col("chunk"))))


def schema_sql(marked):
    return chunks_sql(f"list_filter(list_transform(string_split({marked}, chr(1)), lambda x: {STRIP.format('x')}), lambda x: x <> '')", "doc_id, CAST(k AS INT) AS chunk_index, parts[k] AS chunk")


SCHEMA_ANY = schema_sql("replace(regexp_replace(text, '([.]\\n)', '\\1' || chr(1), 'g'), ', ', ', ' || chr(1))")
SCHEMA_ALL = schema_sql("regexp_replace(text, '(e\\s)', '\\1' || chr(1), 'g')")


@query("chunk_schema_any", SCHEMA_ANY)
def chunk_schema_any(spark, d):
    """Cuts where a full stop ends a line, and behind each comma with a space: rules that never meet."""
    return C.chunk(table(spark, d, "documents").select("doc_id", "text"), C.Schema((C.Rule("pattern", "[.]\\n"), C.Rule("delimiter", ", "))))


@query("chunk_schema_all", SCHEMA_ALL)
def chunk_schema_all(spark, d):
    """Cuts behind ``e`` or a full stop with a white space, and behind ``e`` or a comma with one: only ``e`` has both."""
    return C.chunk(table(spark, d, "documents").select("doc_id", "text"), C.Schema((C.Rule("pattern", "[e.]\\s"), C.Rule("pattern", "[e,]\\s")), "all"))


@query("chunk_sliding_dedup", f"""
WITH f AS (SELECT document_id, file_seq, CASE WHEN overlap_content IS NOT NULL THEN '[OVERLAP] ' || overlap_content || chr(10) ELSE '' END || main_content AS content FROM v_files),
c AS (SELECT document_id, file_seq, {STRIP.format('unnest(string_split(content, chr(10)))')} AS chunk FROM f)
SELECT document_id, chunk, min(file_seq) AS first_file FROM c WHERE chunk <> '' AND NOT starts_with(chunk, '[OVERLAP]') GROUP BY ALL""")
def chunk_sliding_dedup(spark, d):
    return C.sliding(view(spark, d, "v_files"), C.Delimiter("\n")).withColumn("first_file", F.col("first_file").cast("long"))


@query("chunk_cross_file", """WITH o AS (SELECT document_id, list(main_content ORDER BY file_seq) AS x FROM v_files GROUP BY document_id),
f AS (SELECT document_id, list_reduce(x, lambda a, t: list_transform([CASE WHEN a.carry = '' OR regexp_matches(a.carry, '\\s$') OR regexp_matches(t, '^\\s') THEN a.carry || t ELSE a.carry || ' ' || t END], lambda own:
 list_transform([CASE WHEN regexp_matches(own, '\\S') THEN list_transform(range(0, length(own), 1000), lambda i: substring(own, i + 1, 1000)) ELSE [] END], lambda c:
 {'carry': CASE WHEN len(c) > 0 AND length(c[-1]) < 800 THEN c[-1] ELSE '' END, 'chunks': list_concat(a.chunks, CASE WHEN len(c) > 0 AND length(c[-1]) < 800 THEN c[:len(c) - 1] ELSE c END)})[1])[1],
 {'carry': '', 'chunks': []::VARCHAR[]}) AS r FROM o),
c AS (SELECT document_id, CASE WHEN r.carry <> '' THEN list_append(r.chunks, r.carry) ELSE r.chunks END AS c FROM f)
SELECT document_id, CAST(k AS INT) AS chunk_index, c[k] AS chunk FROM (SELECT *, unnest(range(1, len(c) + 1)) AS k FROM c)""")
def chunk_cross_file(spark, d):
    return C.cross_file(files_in_order(spark, d), 1000)


def files_in_order(spark, d):
    """Files by source as ``v_files`` orders them, their ids as file_seq: no window then moves texts. Where ids repeat, the view itself."""
    docs = table(spark, d, "documents")
    if not docs.groupBy("source", "doc_id").count().where("count > 1").isEmpty():
        return view(spark, d, "v_files")
    first = F.lit(-(2**63)).cast("long")  # a null id is the first, as in the view
    if not docs.where(F.col("doc_id") == first).isEmpty():
        return view(spark, d, "v_files")
    return docs.select(F.col("source").alias("document_id"), F.coalesce(F.col("doc_id").cast("long"), first).alias("file_seq"), F.col("text").alias("main_content"))


def cross_fold(cut, unfinished):
    """SQL of the fold over a document's files: how texts are cut, and when the last chunk goes on to the next file."""
    glue = "CASE WHEN a.carry = '' OR v.t = '' OR regexp_matches(a.carry, '[ \\t\\n]$') OR regexp_matches(v.t, '^[ \\t\\n]') THEN a.carry || v.t ELSE a.carry || ' ' || v.t END"
    return f"""WITH o AS (SELECT document_id, list({{'carry': '', 't': main_content, 'last': file_seq = m, 'chunks': []::VARCHAR[]}} ORDER BY file_seq) AS x FROM (SELECT *, max(file_seq) OVER (PARTITION BY document_id) AS m FROM v_files) GROUP BY document_id),
f AS (SELECT document_id, list_reduce(list_prepend({{'carry': '', 't': '', 'last': FALSE, 'chunks': []::VARCHAR[]}}, x), lambda a, v: list_transform([list_transform([{glue}], lambda own: {cut})[1]], lambda c:
 CASE WHEN len(c) > 0 AND NOT v.last AND {unfinished('c[-1]')} THEN {{'carry': c[-1], 't': '', 'last': FALSE, 'chunks': list_concat(a.chunks, c[:len(c) - 1])}} ELSE {{'carry': '', 't': '', 'last': FALSE, 'chunks': list_concat(a.chunks, c)}} END)[1]).chunks AS c FROM o)
SELECT document_id, CAST(k AS INT) AS chunk_index, c[k] AS chunk FROM (SELECT *, unnest(range(1, len(c) + 1)) AS k FROM f)"""


@query("chunk_cross_file_overlap", cross_fold("CASE WHEN regexp_matches(own, '\\S') THEN list_transform(range(0, length(own), 450), lambda i: substring(own, i + 1, 500)) ELSE [] END", lambda c: f"length({c}) < 400"))
def chunk_cross_file_overlap(spark, d):
    """Windows of characters that overlap."""
    return C.cross_file(files_in_order(spark, d), C.Character(500, 50))


@query("chunk_cross_file_token", cross_fold(f"list_transform([{w('own')}], lambda ws: list_transform(range(0, len(ws), 56), lambda i: array_to_string(ws[i + 1:i + 64], ' ')))[1]", lambda c: f"len({w(c)}) < 0.8::DOUBLE * 64"))
def chunk_cross_file_token(spark, d):
    """Windows of words that overlap."""
    return C.cross_file(files_in_order(spark, d), C.Token(64, 8))


@query("chunk_cross_file_delimiter", cross_fold(f"list_filter(list_transform(string_split(own, '.' || chr(10)), lambda x: {STRIP.format('x')}), lambda x: x <> '')", lambda c: f"NOT ends_with({c}, '.' || chr(10))"))
def chunk_cross_file_delimiter(spark, d):
    """Parts between delimiters: a file's last part goes on to the next."""
    return C.cross_file(view(spark, d, "v_files"), C.Delimiter(".\n"))


@query("chunk_cross_file_schema", cross_fold(f"list_filter(list_transform(string_split(regexp_replace(own, '(?m)(^[A-Z][a-z]+ )', chr(1) || '\\1', 'g'), chr(1)), lambda x: {STRIP.format('x')}), lambda x: x <> '')", lambda c: f"(regexp_matches({c}, '^[A-Z][a-z]+ ') AND len(regexp_extract_all({c}, '(?m)^[A-Z][a-z]+ ')) <= 1)"))
def chunk_cross_file_schema(spark, d):
    """Sections that begin with a line of a pattern."""
    return C.cross_file(view(spark, d, "v_files"), C.Schema((C.Rule("pattern", "^[A-Z][a-z]+ ", True),)))


@query("chunk_unfinished", """
SELECT document_id, file_seq, n < 0.8::DOUBLE * 512 AS unfinished_character, length(main_content) < 200 OR NOT regexp_matches(main_content, '[.!?"]\\s*$') AS unfinished_semantic
FROM (SELECT *, length(main_content) - 462 * ((length(main_content) - 1) // 462) AS n FROM v_files WHERE main_content <> '')""")
def chunk_unfinished(spark, d):
    files = view(spark, d, "v_files")
    whole = C.Character(512, 50)
    last = F.element_at(whole.column(F.col("main_content")), -1)
    semantic = C.Headings("headings").unfinished(F.col("main_content"))
    return files.where("main_content <> ''").select("document_id", F.col("file_seq").cast("long").alias("file_seq"), whole.unfinished(last).alias("unfinished_character"), semantic.alias("unfinished_semantic"))


@query("chunk_stats", f"""
WITH r AS (SELECT lang, length(text) AS n, len({w('text')}) AS w FROM documents)
SELECT lang, count(*) AS n, avg(n) AS avg_len, CAST(min(n) AS INT) AS min_len, CAST(max(n) AS INT) AS max_len,
       CAST(list_sort(list(n))[count(*) // 2 + 1] AS BIGINT) AS upper_median_len, CAST(list_sort(list(w))[count(*) // 2 + 1] AS BIGINT) AS upper_median_words FROM r GROUP BY lang""")
def chunk_stats(spark, d):
    return C.distribution(table(spark, d, "documents"), "lang")


@query("page_split_plan", """
WITH s AS (SELECT doc_id, total_pages AS n, unnest(range(0, 1 + CAST(greatest(0, ceil((total_pages - 20) / 18.0)) AS INT))) AS k, CAST(greatest(0, ceil((total_pages - 20) / 18.0)) AS INT) AS last FROM v_pdf WHERE total_pages > 0)
SELECT doc_id, CAST(k + 1 AS INT) AS chunk_number, CAST(k * 18 + 1 AS INT) AS start_page, CAST(least(k * 18 + 20, n) AS INT) AS end_page,
       CAST(CASE WHEN k > 0 THEN k END AS INT) AS prev_chunk, CAST(CASE WHEN k < last THEN k + 2 END AS INT) AS next_chunk FROM s""")
def page_split_plan(spark, d):
    return C.page_splits(view(spark, d, "v_pdf"), "total_pages", 20, 2)


@query("doc_text_stats", f"SELECT doc_id, CAST(length(text) AS INT) AS total_length, CAST(len({w('text')}) AS INT) AS words, CAST(len(string_split(text, chr(10))) AS INT) AS lines, CAST({sentences('text')} AS INT) AS sentences FROM documents")
def doc_text_stats(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.length(t).alias("total_length"), F.size(X.words(t)).alias("words"), F.size(F.split(t, "\n")).alias("lines"), X.sentence_count(t).alias("sentences"))


@query("readability", f"SELECT doc_id, CAST({syllables('text')} AS INT) AS syllables, round({flesch('text')}, 6) AS flesch, round({complexity('text')}, 6) AS complexity FROM documents")
def readability(spark, d):
    t = F.col("text")
    counted = table(spark, d, "documents").select("doc_id", "text", X.syllable_count(t).alias("syllables"))
    return counted.select("doc_id", "syllables", F.round(X.flesch(t, F.col("syllables")), 6).alias("flesch"), F.round(X.complexity(t), 6).alias("complexity"))


DENSITY = ("the", "and", "der", "les", "que")


@query("information_density_topk", f"""
WITH r AS (SELECT doc_id, text, {w('text')} AS t FROM documents),
f AS (SELECT doc_id, max(c) AS top FROM (SELECT doc_id, x, count(*) AS c FROM (SELECT doc_id, unnest(t) AS x FROM r) GROUP BY ALL) GROUP BY doc_id),
s AS (SELECT doc_id, CASE WHEN len(t) > 0 THEN least(1.0::DOUBLE, length(text) / 1000.0::DOUBLE) * 0.3::DOUBLE + len(list_distinct(t))::DOUBLE / len(t) * 0.3::DOUBLE
      + (1.0::DOUBLE - top::DOUBLE / len(t)) * 0.2::DOUBLE + len(list_filter(t, lambda x: lower(x) IN ('the', 'and', 'der', 'les', 'que')))::DOUBLE / len(t) * 0.2::DOUBLE ELSE 0 END AS score
      FROM r LEFT JOIN f USING (doc_id))
SELECT doc_id, round(score, 6) AS score FROM s ORDER BY round(score, 6) DESC, doc_id LIMIT 100""")
def information_density_topk(spark, d):
    scored = table(spark, d, "documents").select("doc_id", F.round(X.information_density(F.col("text"), DENSITY), 6).alias("score"))
    return scored.orderBy(F.col("score").desc(), "doc_id").limit(100)


@query("header_lines", f"""
WITH l AS (SELECT doc_id, {STRIP.format('unnest(string_split(text, chr(10)))')} AS s FROM documents),
c AS (SELECT doc_id, s, len(regexp_extract_all(s, '\\p{{L}}')) AS letters, len(regexp_extract_all(s, '\\p{{Lu}}')) AS capitals FROM l)
SELECT doc_id, CAST(count_if(starts_with(s, '#') OR (length(s) > 3 AND capitals > 0 AND s = upper(s)) OR (letters > 3 AND capitals > 0.8 * letters)) AS INT) AS n_headers FROM c GROUP BY doc_id""")
def header_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", C.headers(F.col("text")).alias("n_headers"))


@query("content_pages", "SELECT doc_id, CAST(k AS INT) AS page, CAST(ceil(length(text) / 1000.0) AS INT) AS total_pages, substring(text, (k - 1) * 1000 + 1, 1000) AS content FROM (SELECT *, unnest(range(1, 1 + CAST(ceil(length(text) / 1000.0) AS INT))) AS k FROM documents)")
def content_pages(spark, d):
    """Fixed-size pages of every text, with the number of pages."""
    pages = C.chunk(table(spark, d, "documents").select("doc_id", "text", F.ceil(F.length("text") / 1000).cast("int").alias("total_pages")), C.Character(1000, 0))
    return pages.select("doc_id", F.col("chunk_index").alias("page"), "total_pages", F.col("chunk").alias("content"))


@query("content_sample", """
SELECT doc_id, substring(text, 1, n) AS head, substring(text, length(text) // 2 - n // 2 + 1, n) AS middle, right(text, n) AS tail
FROM (SELECT *, CAST(least(5000, length(text) // 3) AS INT) AS n FROM documents WHERE length(text) > 10000)""")
def content_sample(spark, d):
    """Begin, middle and end of long texts."""
    t, n = F.col("text"), F.least(F.lit(5000), F.floor(F.length("text") / 3)).cast("int")
    half = (F.floor(F.length("text") / 2) - F.floor(n / 2) + 1).cast("int")
    return table(spark, d, "documents").where(F.length("text") > 10000).select("doc_id", F.substring(t, F.lit(1), n).alias("head"), F.substring(t, half, n).alias("middle"), F.right(t, n).alias("tail"))


EXAMPLES = ["Plain line\nThe of, and\nno", "  @example  "]
SECTION = """l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
h AS (SELECT doc_id, l, list_filter(range(1, len(l) + 1), lambda k: contains(lower(l[k]), 'the of, and') OR contains(lower(l[k]), '@example') OR (upper(trim(l[k])) = trim(l[k]) AND lower(l[k]) <> l[k])) AS hits FROM l)"""


@query("pattern_contexts", f"""WITH {SECTION}, s AS (SELECT doc_id, list_transform(hits, lambda k: array_to_string(l[greatest(k - 2, 1):k + 2], chr(10))) AS s FROM h)
SELECT doc_id, CAST(len(list_distinct(s)) AS INT) AS sections, sha256(array_to_string(list_filter(s, lambda x, i: list_position(s, x) = i), chr(10) || '--' || chr(10))) AS digest FROM s""")
def pattern_contexts(spark, d):
    """Lines within two of those that a user's examples, or capitals, point at."""
    own = V.contexts(F.col("text"), V.patterns(EXAMPLES))
    return table(spark, d, "documents").select("doc_id", F.size(own).alias("sections"), F.sha2(F.array_join(own, "\n--\n"), 256).alias("digest"))


@query("pattern_intervals", f"""WITH {SECTION}, w AS (SELECT doc_id, l, unnest(hits) AS k FROM h), b AS (SELECT DISTINCT doc_id, unnest(range(greatest(k - 2, 1), least(k + 2, len(l)) + 1)) AS k FROM w),
g AS (SELECT doc_id, k, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS run FROM b)
SELECT doc_id, CAST(min(k) - 1 AS INT) AS first, CAST(max(k) - 1 AS INT) AS last FROM g GROUP BY doc_id, run""")
def pattern_intervals(spark, d):
    """The same lines as merged intervals."""
    lines = F.split("text", "\n")
    wanted = V.patterns(EXAMPLES)
    hit = lambda x: F.contains(F.lower(x), F.lit(wanted[0].lower())) | F.contains(F.lower(x), F.lit(wanted[1].lower())) | V.capitals(F.trim(x))
    hits = F.filter(F.transform(lines, lambda x, k: F.when(hit(x), k)), lambda k: k.isNotNull())
    return table(spark, d, "documents").select("doc_id", F.explode(V.intervals(hits, F.size(lines), 2)).alias("x")).select("doc_id", "x.first", "x.last")


@query("smart_sample_text", f"""WITH {SECTION}, s AS (SELECT doc_id, list_transform(hits, lambda k: array_to_string(l[greatest(k - 2, 1):k + 2], chr(10))) AS s, l FROM h),
n AS (SELECT doc_id, text, CAST(least(5000, length(text) // 3) AS INT) AS n, list_filter(s, lambda x, i: list_position(s, x) = i) AS s,
 list_filter(list_transform(l[1:100], lambda x: {STRIP.format('x')}), lambda x: starts_with(x, '#') OR (length(x) < 100 AND length(x) > 0 AND upper(left(x, 1)) = left(x, 1) AND lower(left(x, 1)) <> left(x, 1)))[1:10] AS heads FROM s JOIN documents USING (doc_id))
SELECT doc_id, sha256(CASE WHEN length(text) <= 10000 THEN text WHEN len(s) > 0 THEN '=== RELEVANT SECTIONS MATCHING USER EXAMPLES ===' || chr(10) || array_to_string(s[1:5], chr(10))
 ELSE '=== KEY HEADERS/TITLES ===' || chr(10) || array_to_string(heads, chr(10)) || chr(10) || chr(10) || '=== BEGINNING SECTION ===' || chr(10) || substring(text, 1, n) || chr(10) || chr(10) || '=== MIDDLE SECTION ===' || chr(10) ||
  substring(text, length(text) // 2 - n // 2 + 1, n) || chr(10) || chr(10) || '=== END SECTION ===' || chr(10) || right(text, n) END) AS digest FROM n""")
def smart_sample_text(spark, d):
    """Short texts whole, long ones by sections around examples or by their parts."""
    return table(spark, d, "documents").select("doc_id", F.sha2(V.sample(F.col("text"), EXAMPLES), 256).alias("digest"))


@query("normalise_markdown", """
SELECT doc_id, sha256(array_to_string(list_transform(string_split(regexp_replace(text, '\\n{4,}', chr(10) || chr(10) || chr(10), 'g'), chr(10)),
       lambda x: CASE WHEN contains(x, '|') THEN rtrim(x) ELSE rtrim(regexp_replace(x, ' {2,}', ' ', 'g')) END), chr(10))) AS digest FROM documents""")
def normalise_markdown(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(X.normalise_markdown(F.col("text")), 256).alias("digest"))


@query("image_tag_strip", "SELECT doc_id, sha256(regexp_replace('[Image: ' || doc_id || '] ' || text, '\\[Image:.*?\\]', '', 'g')) AS digest FROM documents")
def image_tag_strip(spark, d):
    tagged = F.concat(F.lit("[Image: "), F.col("doc_id").cast("string"), F.lit("] "), F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.sha2(X.strip_image_tags(tagged), 256).alias("digest"))
