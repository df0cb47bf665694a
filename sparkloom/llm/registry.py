"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid, phrases, pieces, pii, quality, quotes, secrets, simhash, topk, variants, warc, wrappers


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best other rows for every vector whose id is divisible by 20."""
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by its host's wrapper."""
    return wrappers.main_text(_table(spark, sf_dir, "pages"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint and component_id of every document."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16("fp").alias("fingerprint"), "component_id")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by Kneser-Ney character models."""
    return langid.identified(_table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", "entropy", "rejected")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by positive-unlabelled learning."""
    return quality.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), quality.by_crc)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside 10-word windows of benchmark items."""
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def model_path() -> str:
    """The vocabulary file of the queries; the package that knows its place is needed by nothing else."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document and whether they decode to its text."""
    return pieces.tokenised(_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model_path())


def op8_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message without quotes, with what it replies to, in reply order."""
    return quotes.ordered(quotes.conversations(_table(spark, sf_dir, "conversations")))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates and secrets of every document, and a digest of the secrets in text order."""
    found = secrets.findings(_table(spark, sf_dir, "documents"))
    tokens = F.transform("found", lambda f: f["token"])
    return found.select("doc_id", "n_candidates", F.size("found").cast("long").alias("n_secrets"), F.sha2(F.array_join(tokens, "\n"), 256).alias("secrets_sha256"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record of an archive that is read back."""
    return warc.archived(_table(spark, sf_dir, "pages"))


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, root and neighbours of every word of the documents; one document word in 97 lacks a letter."""
    return variants.grouped(variants.word_counts(_table(spark, sf_dir, "documents"), every=97))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts of strict spans, their digest, and all spans."""
    found = pii.findings(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[f"n_{k}" for k in pii.KINDS], F.sha2("base", 256).alias("base_sha256"), "spans")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of two or three words of every language."""
    return phrases.collocations(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_topk": op1_topk,
    "op2_wrappers": op2_wrappers,
    "op3_simhash": op3_simhash,
    "op4_langid": op4_langid,
    "op5_quality": op5_quality,
    "op6_decontaminate": op6_decontaminate,
    "op7_pieces": op7_pieces,
    "op8_quotes": op8_quotes,
    "op9_secrets": op9_secrets,
    "op10_warc": op10_warc,
    "op11_variants": op11_variants,
    "op12_pii": op12_pii,
    "op13_phrases": op13_phrases,
}

ORACLE_SQL = {
    "op1_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.v, d.v) AS BIGINT) AS score FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
""",
    "op10_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, array_to_string(list_transform(range(32), lambda k:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, 5 * (k // 4) + 1, 5) AS INT) >> CAST(15 - 5 * (k % 4) AS INT)) & 31), 1)), '') AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to FROM f
""",
    "op6_decontaminate": r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^0-9a-z\x{80}-\x{10FFFF}]+'), lambda t: t <> '') AS w FROM documents),
bw AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^0-9a-z\x{80}-\x{10FFFF}]+'), lambda t: t <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS win
        FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM bw WHERE len(w) > 0)),
dwin AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hits AS (SELECT doc_id, dwin.n, k, item_id FROM dwin JOIN win ON dwin.n = win.n AND dwin.win = win.win),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids FROM hits GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op11_variants": r"""
WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
runs AS (SELECT doc_id, r, count(*) AS m FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS r FROM documents) GROUP BY ALL),
hex AS (SELECT r, m, hex(encode(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', r))) AS x FROM runs),
h AS (SELECT r, m, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) AS h FROM hex, crc),
w AS (SELECT word, CAST(sum(m) AS BIGINT) AS n FROM (SELECT m, CASE WHEN h % 97 = 0 THEN substr(r, 1, h % len(r)) || substr(r, h % len(r) + 2) ELSE r END AS word FROM h) WHERE len(word) >= 5 GROUP BY word HAVING sum(m) >= 3),
cut AS (SELECT word, n, k, substr(word, 1, k - 1) || '*' || substr(word, k + 1) AS gap, substr(word, 1, k - 1) || substr(word, k + 1) AS less FROM (SELECT word, n, unnest(range(1, len(word) + 1)) AS k FROM w)),
shorter AS (SELECT DISTINCT c.word AS a, s.word AS b FROM cut c JOIN w s ON s.word = c.less),
near AS (SELECT x.word AS a, y.word AS b FROM cut x JOIN cut y ON x.gap = y.gap AND x.word <> y.word UNION ALL SELECT a, b FROM shorter UNION ALL SELECT b, a FROM shorter),
best AS (SELECT a, count(*) AS n_near, first(b ORDER BY n DESC, b) AS form, max(n) AS form_n FROM near JOIN w ON w.word = b GROUP BY a),
linked AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * w.n THEN form END AS form, CASE WHEN form_n >= 2 * w.n THEN form_n END AS form_n FROM w LEFT JOIN best ON best.a = w.word),
walk AS (SELECT word, word AS root, form AS ahead FROM linked UNION ALL SELECT walk.word, l.word, l.form FROM walk JOIN linked l ON l.word = walk.ahead)
SELECT l.word, l.form, walk.root, l.n, l.n_near, l.form_n FROM linked l JOIN walk ON walk.word = l.word AND walk.ahead IS NULL
""",
    "op13_phrases": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k))),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS v FROM f WHERE k > 1 AND a >= 10),
cut AS (SELECT lang, k, phrase, a, v, j, array_to_string(v[1:j], ' ') AS x, array_to_string(v[j + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
s AS (SELECT cut.*, fx.a AS l, fy.a AS r, CAST((CAST(1000000 AS HUGEINT) * cut.a * cut.a) // (CAST(fx.a AS HUGEINT) * fy.a) AS BIGINT) AS score
      FROM cut JOIN f fx ON fx.lang = cut.lang AND fx.phrase = x JOIN f fy ON fy.lang = cut.lang AND fy.phrase = y),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS nr FROM s) WHERE nr = 1),
inner2 AS (SELECT lang, array_to_string(v[1:2], ' ') AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, array_to_string(v[2:3], ' '), a FROM c WHERE k = 3),
kept AS (SELECT * FROM one o WHERE k = 3 OR NOT EXISTS (SELECT 1 FROM inner2 i WHERE i.lang = o.lang AND i.phrase = o.phrase AND 100 * i.a >= 50 * o.a)),
total AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
""",
}
