"""Queries over model evaluation."""

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..session import table
from .catalog import query
from .q_chunking import w
from .q_quality import r6
from .views import view

CONF = """c AS (SELECT k AS class, count_if(prediction = k AND label = k) AS tp, count_if(prediction = k AND label <> k) AS fp, count_if(prediction <> k AND label = k) AS fn
 FROM v_pred, (SELECT prediction AS k FROM v_pred UNION SELECT label FROM v_pred) GROUP BY k),
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS r FROM c),
f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM m)"""


@query("accuracy", "SELECT round(avg(CAST(prediction = label AS INT)), 6) AS accuracy FROM v_pred")
def accuracy(spark, d):
    return r6(E.accuracy(view(spark, d, "v_pred")))


@query("prf_macro", f"WITH {CONF} SELECT round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(f1), 6) AS f1 FROM f")
def prf_macro(spark, d):
    return r6(E.macro(view(spark, d, "v_pred")))


@query("prf_binary", f"""WITH {CONF}, t AS (SELECT tp, fp, fn, (SELECT tp FROM c WHERE class = 0) AS tn FROM c WHERE class = 1)
SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, round((SELECT (tp * tn - fp * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) FROM t), 6) AS mcc FROM f WHERE class = 1""")
def prf_binary(spark, d):
    return r6(E.binary(view(spark, d, "v_pred")))


@query("glue_answers", """SELECT doc_id, CAST(CASE WHEN quality = 0 THEN 0 ELSE 1 END AS INT) AS parsed, 'a ' || doc_id || ' [SEP] b' AS pair FROM labels""")
def glue_answers(spark, d):
    """Answers in words, read back as classes, and a sentence pair as one input."""
    answer = F.when(F.col("quality") == 0, "This is UNACCEPTABLE.").otherwise("Clearly acceptable")
    return table(spark, d, "labels").select("doc_id", E.parse_answer(answer, "cola").alias("parsed"), F.concat_ws(" [SEP] ", F.concat(F.lit("a "), F.col("doc_id").cast("string")), F.lit("b")).alias("pair"))


def grams(n):
    return f"""g{n} AS (SELECT qa_id, side, array_to_string(t[k:k + {n - 1}], ' ') AS g, count(*) AS n FROM (SELECT *, unnest(range(1, len(t) - {n} + 2)) AS k FROM tk WHERE len(t) >= {n}) GROUP BY ALL),
m{n} AS (SELECT a.qa_id, sum(least(a.n, b.n)) AS m FROM g{n} a JOIN g{n} b ON a.qa_id = b.qa_id AND a.g = b.g AND a.side = 'p' AND b.side = 'r' GROUP BY a.qa_id),
z{n} AS (SELECT q.qa_id, coalesce(m, 0) AS m, greatest(0, len(p) - {n - 1}) AS np, greatest(0, len(r) - {n - 1}) AS nr FROM (SELECT qa_id, {w('lower(answer)')} AS p, {w('lower(question)')} AS r FROM v_qa) q LEFT JOIN m{n} USING (qa_id))"""


TK = f"tk AS (SELECT qa_id, 'p' AS side, {w('lower(answer)')} AS t FROM v_qa UNION ALL SELECT qa_id, 'r', {w('lower(question)')} FROM v_qa)"


def pairs(spark, d):
    return view(spark, d, "v_qa").select("qa_id", F.col("answer").alias("prediction"), F.col("question").alias("reference"))


@query("bleu_ws", f"""WITH {TK}, {', '.join(grams(n) for n in (1, 2, 3, 4))},
p AS (SELECT {', '.join(f"(SELECT sum(m)::DOUBLE / sum(np) FROM z{n}) AS p{n}" for n in (1, 2, 3, 4))}, (SELECT sum(np) FROM z1)::DOUBLE AS c, (SELECT sum(nr) FROM z1)::DOUBLE AS r),
b AS (SELECT *, CASE WHEN c >= r THEN 1 ELSE exp(1 - r / c) END AS brevity FROM p)
SELECT {', '.join(f"round(p{n}, 6) AS p{n}" for n in (1, 2, 3, 4))}, round(brevity, 6) AS brevity,
 round(CASE WHEN least(p1, p2, p3, p4) = 0 THEN 0 ELSE brevity * exp((ln(greatest(p1, 1e-300)) + ln(greatest(p2, 1e-300)) + ln(greatest(p3, 1e-300)) + ln(greatest(p4, 1e-300))) / 4) END, 6) AS bleu FROM b""")
def bleu_ws(spark, d):
    return r6(E.bleu(pairs(spark, d)))


@query("rouge12", f"""WITH {TK}, {grams(1)}, {grams(2)},
f AS (SELECT n, CASE WHEN np > 0 THEN m::DOUBLE / np ELSE 0 END AS p, CASE WHEN nr > 0 THEN m::DOUBLE / nr ELSE 0 END AS r FROM (SELECT 1 AS n, * FROM z1 UNION ALL SELECT 2, * FROM z2)),
h AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM f)
SELECT {', '.join(f"round(avg({c}) FILTER (n = {n}), 6) AS rouge{n}_{c}" for n in (1, 2) for c in 'prf')} FROM h""")
def rouge12(spark, d):
    return r6(E.rouge(pairs(spark, d), 1, 2))


@query("rouge_l", f"""WITH t AS (SELECT {w('lower(answer)')} AS p, {w('lower(question)')} AS r FROM v_qa),
l AS (SELECT len(p) AS np, len(r) AS nr, list_reduce(p, lambda row, x: list_reduce(range(1, len(r) + 1), lambda acc, j: list_append(acc, CASE WHEN x = r[j] THEN row[j] + 1 ELSE greatest(acc[-1], row[j + 1]) END), [0]), list_transform(range(0, len(r) + 1), lambda i: 0))[-1] AS m FROM t),
f AS (SELECT CASE WHEN np > 0 THEN m::DOUBLE / np ELSE 0 END AS p, CASE WHEN nr > 0 THEN m::DOUBLE / nr ELSE 0 END AS r FROM l),
h AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM f)
SELECT round(avg(p), 6) AS "rougeL_p", round(avg(r), 6) AS "rougeL_r", round(avg(f), 6) AS "rougeL_f" FROM h""")
def rouge_l(spark, d):
    return r6(E.rouge_l(pairs(spark, d)))


@query("meteor_exact", f"""WITH t AS (SELECT {w('lower(answer)')} AS p, {w('lower(question)')} AS r FROM v_qa),
a AS (SELECT len(p) AS np, len(r) AS nr, list_transform(range(1, len(p) + 1), lambda i: list_filter(range(1, len(r) + 1), lambda j: r[j] = p[i])[len(list_filter(p[1:i], lambda x: x = p[i]))]) AS hits FROM t),
c AS (SELECT np, nr, len(list_filter(hits, lambda x: x IS NOT NULL)) AS m, len(list_filter(range(1, np + 1), lambda i: hits[i] IS NOT NULL AND (i = 1 OR hits[i - 1] IS NULL OR hits[i - 1] + 1 <> hits[i]))) AS chunks FROM a),
s AS (SELECT CASE WHEN m = 0 THEN 0.0::DOUBLE ELSE 10 * (m::DOUBLE / np) * (m::DOUBLE / nr) / (m::DOUBLE / nr + 9 * (m::DOUBLE / np)) * (1 - 0.5::DOUBLE * pow(chunks::DOUBLE / m, 3)) END AS s FROM c)
SELECT round(avg(s), 6) AS meteor FROM s""")
def meteor_exact(spark, d):
    return r6(E.meteor_exact(pairs(spark, d)))


#: Porter's steps in SQL, spelled out: suffixes in the order in which they are tried.
CON, VOW = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
M0, M1, ONLY = f"'^({CON})?{VOW}{CON}'", f"'^({CON})?{VOW}{CON}{VOW}{CON}'", f"'^({CON})?{VOW}{CON}({VOW})?$'"
CVC = f"'^{CON}[aeiouy][^aeiouwxy]$|^[aeiou][^aeiou]$'"
OPEN = "'[aeiou]$|[^aeiouy]y$|^y$'"
SUFFIX2 = "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble fulli:ful"
SUFFIX3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
SUFFIX4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def suffixes(rules, least, extra=""):
    cases = []
    for rule in rules.split():
        old, _, new = rule.partition(":")
        base = f"left(w, len(w) - {len(old)})"
        more = " AND regexp_matches(left(w, len(w) - 3), '[st]$')" if old == "ion" else ""
        cases.append(f"WHEN ends_with(w, '{old}') THEN CASE WHEN regexp_matches({base}, {least}){more} THEN {base} || '{new}' ELSE w END")
    return f"CASE {extra} {' '.join(cases)} ELSE w END"


def stems(words):
    """CTEs up to ``stems`` (word, stem) of a relation of words."""
    cut = lambda n: f"left(w, len(w) - {n})"
    double = f"len(w) > 1 AND right(w, 1) = w[-2] AND NOT regexp_matches(w, {OPEN})"
    return f"""st0 AS (SELECT word, CASE WHEN starts_with(word, 'y') THEN 'Y' || substr(word, 2) ELSE word END AS w FROM {words}),
st1 AS (SELECT word, CASE WHEN ends_with(w, 'ies') THEN CASE WHEN len(w) = 4 THEN {cut(1)} ELSE {cut(2)} END WHEN ends_with(w, 'sses') THEN {cut(2)} WHEN ends_with(w, 'ss') THEN w WHEN ends_with(w, 's') THEN {cut(1)} ELSE w END AS w FROM st0),
st2 AS (SELECT word, CASE WHEN ends_with(w, 'ied') THEN 'no' WHEN ends_with(w, 'eed') THEN 'no' WHEN ends_with(w, 'ed') AND regexp_matches({cut(2)}, '^({CON})?[aeiouy]') THEN 'yes' WHEN ends_with(w, 'ing') AND regexp_matches({cut(3)}, '^({CON})?[aeiouy]') THEN 'yes' ELSE 'no' END AS past,
 CASE WHEN ends_with(w, 'ied') THEN CASE WHEN len(w) = 4 THEN {cut(1)} ELSE {cut(2)} END WHEN ends_with(w, 'eed') THEN CASE WHEN regexp_matches({cut(3)}, {M0}) THEN {cut(1)} ELSE w END
      WHEN ends_with(w, 'ed') AND regexp_matches({cut(2)}, '^({CON})?[aeiouy]') THEN {cut(2)} WHEN ends_with(w, 'ing') AND regexp_matches({cut(3)}, '^({CON})?[aeiouy]') THEN {cut(3)} ELSE w END AS w FROM st1),
st3 AS (SELECT word, CASE WHEN past = 'no' THEN w WHEN regexp_matches(w, '(at|bl|iz)$') THEN w || 'e' WHEN {double} THEN CASE WHEN right(w, 1) IN ('l', 's', 'z') THEN w ELSE {cut(1)} END WHEN regexp_matches(w, {ONLY}) AND regexp_matches(w, {CVC}) THEN w || 'e' ELSE w END AS w FROM st2),
st4 AS (SELECT word, CASE WHEN ends_with(w, 'y') AND len(w) > 2 AND NOT regexp_matches({cut(1)}, {OPEN}) THEN {cut(1)} || 'i' ELSE w END AS w FROM st3),
st5 AS (SELECT word, CASE WHEN ends_with(w, 'alli') AND regexp_matches({cut(4)}, {M0}) THEN {cut(2)} ELSE w END AS w FROM st4),
st6 AS (SELECT word, {suffixes(SUFFIX2, M0, f"WHEN ends_with(w, 'logi') THEN CASE WHEN regexp_matches({cut(3)}, {M0}) THEN {cut(1)} ELSE w END")} AS w FROM st5),
st7 AS (SELECT word, {suffixes(SUFFIX3, M0)} AS w FROM st6), st8 AS (SELECT word, {suffixes(SUFFIX4, M1)} AS w FROM st7),
st9 AS (SELECT word, CASE WHEN ends_with(w, 'e') AND (regexp_matches({cut(1)}, {M1}) OR regexp_matches({cut(1)}, {ONLY}) AND NOT regexp_matches({cut(1)}, {CVC})) THEN {cut(1)} ELSE w END AS w FROM st8),
stems AS (SELECT word, CASE WHEN len(word) < 3 THEN word WHEN word IN ('sky', 'skies') THEN 'sky' WHEN word IN ('dying', 'lying', 'tying') THEN left(word, 1) || 'ie' WHEN word IN ('news', 'howe', 'proceed', 'exceed', 'succeed') THEN word
 WHEN regexp_matches(word, '^(inn|out|cann)ings?$') THEN rtrim(word, 's') WHEN ends_with(w, 'll') AND regexp_matches({cut(1)}, {M1}) THEN replace({cut(1)}, 'Y', 'y') ELSE replace(w, 'Y', 'y') END AS stem FROM st9)"""


ENGLISH = "CASE qa_id % 6 WHEN 0 THEN ' Running dogs and happy ponies' WHEN 1 THEN ' The relational generalization failed; troubled callousness agreed' WHEN 2 THEN ' ran hopefully, hopping electricity controlling' WHEN 3 THEN ' A run of conditional agreements was troubling' WHEN 4 THEN ' Ponies: happily sized digitizers, adoption' ELSE ' yes, yellow replacements' END"
ROUGE_TEXTS = f"SELECT qa_id, answer || {ENGLISH} || {ENGLISH.replace('qa_id', '(qa_id + 1)')} AS p, question || {ENGLISH.replace('qa_id', '(qa_id + 3)')} || {ENGLISH} AS r FROM v_qa"


def english(spark, d):
    """Pairs of the conversations with some English behind, so that there are stems to share."""
    rows = pairs(spark, d)
    text = lambda k: F.expr(ENGLISH.replace("qa_id", f"(qa_id + {k})"))
    return rows.select("qa_id", F.concat("prediction", text(0), text(1)).alias("prediction"), F.concat("reference", text(3), text(0)).alias("reference"))


STEMMED = f"""x AS ({ROUGE_TEXTS}), z AS (SELECT qa_id, list_filter(regexp_split_to_array(lower(p), '[^a-z0-9]+'), lambda x: x <> '') AS p, list_filter(regexp_split_to_array(lower(r), '[^a-z0-9]+'), lambda x: x <> '') AS r FROM x),
tok AS (SELECT qa_id, 'p' AS side, unnest(p) AS word, generate_subscripts(p, 1) AS k FROM z UNION ALL SELECT qa_id, 'r', unnest(r), generate_subscripts(r, 1) FROM z),
words AS (SELECT DISTINCT word FROM tok WHERE len(word) > 3), {stems('words')},
st AS (SELECT qa_id, side, list(coalesce(stem, word) ORDER BY k) AS t FROM tok LEFT JOIN stems USING (word) GROUP BY ALL),
tp AS (SELECT z.qa_id, coalesce(a.t, []) AS p, coalesce(b.t, []) AS r FROM z LEFT JOIN st a ON a.qa_id = z.qa_id AND a.side = 'p' LEFT JOIN st b ON b.qa_id = z.qa_id AND b.side = 'r')"""


def stem_grams(n):
    side = lambda c: f"SELECT qa_id, array_to_string({c}[k:k + {n - 1}], ' ') AS g, count(*) AS n FROM (SELECT qa_id, {c}, unnest(range(1, len({c}) - {n} + 2)) AS k FROM tp) GROUP BY ALL"
    return f"""z{n} AS (SELECT {n} AS n, tp.qa_id, coalesce(m, 0) AS m, greatest(0, len(p) - {n - 1}) AS np, greatest(0, len(r) - {n - 1}) AS nr FROM tp LEFT JOIN
 (SELECT a.qa_id, sum(least(a.n, b.n)) AS m FROM ({side('p')}) a JOIN ({side('r')}) b ON a.qa_id = b.qa_id AND a.g = b.g GROUP BY a.qa_id) USING (qa_id))"""


@query("rouge_stemmed", f"""WITH {STEMMED}, {stem_grams(1)}, {stem_grams(2)},
zl AS (SELECT 3 AS n, qa_id, list_reduce(list_prepend(list_transform(range(0, len(r) + 1), lambda i: 0), list_transform(range(1, len(p) + 1), lambda i: [i])), lambda row, x: list_reduce(list_prepend([0], list_transform(range(1, len(r) + 1), lambda j: [j])), lambda acc, j: list_append(acc, CASE WHEN p[x[1]] = r[j[1]] THEN row[j[1]] + 1 ELSE greatest(acc[-1], row[j[1] + 1]) END)))[-1] AS m, len(p) AS np, len(r) AS nr FROM tp),
f AS (SELECT n, CASE WHEN np > 0 THEN m::DOUBLE / np ELSE 0 END AS p, CASE WHEN nr > 0 THEN m::DOUBLE / nr ELSE 0 END AS r FROM (SELECT * FROM z1 UNION ALL SELECT * FROM z2 UNION ALL SELECT * FROM zl)),
h AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM f)
SELECT {', '.join(f'round(avg({c}) FILTER (n = {n}), 6) AS "rouge{k}_{c}"' for n, k in ((1, '1'), (2, '2'), (3, 'L')) for c in 'prf')} FROM h""")
def rouge_stemmed(spark, d):
    """ROUGE over stems."""
    return r6(E.rouge_stemmed(english(spark, d)))


@query("meteor", f"""WITH x AS ({ROUGE_TEXTS}), z AS (SELECT qa_id, {w('lower(p)')} AS p, {w('lower(r)')} AS r FROM x),
tok AS (SELECT qa_id, 'p' AS side, unnest(p) AS word, generate_subscripts(p, 1) AS k FROM z UNION ALL SELECT qa_id, 'r', unnest(r), generate_subscripts(r, 1) FROM z),
words AS (SELECT DISTINCT word FROM tok), {stems('words')},
e1 AS (SELECT *, row_number() OVER (PARTITION BY qa_id, side, word ORDER BY k DESC) AS nth FROM tok),
m1 AS (SELECT a.qa_id, a.k AS i, b.k AS j FROM e1 a JOIN e1 b ON a.qa_id = b.qa_id AND a.word = b.word AND a.nth = b.nth AND a.side = 'p' AND b.side = 'r'),
rest AS (SELECT t.qa_id, side, k, stem FROM tok t JOIN stems USING (word) WHERE NOT EXISTS (SELECT 1 FROM m1 WHERE m1.qa_id = t.qa_id AND (side = 'p' AND i = k OR side = 'r' AND j = k))),
e2 AS (SELECT *, row_number() OVER (PARTITION BY qa_id, side, stem ORDER BY k DESC) AS nth FROM rest),
m AS (SELECT * FROM m1 UNION ALL SELECT a.qa_id, a.k, b.k FROM e2 a JOIN e2 b ON a.qa_id = b.qa_id AND a.stem = b.stem AND a.nth = b.nth AND a.side = 'p' AND b.side = 'r'),
c AS (SELECT qa_id, count(*) AS m, count(*) FILTER (WHERE pi IS NULL OR pi + 1 <> i OR pj + 1 <> j) AS chunks FROM (SELECT *, lag(i) OVER (PARTITION BY qa_id ORDER BY i) AS pi, lag(j) OVER (PARTITION BY qa_id ORDER BY i) AS pj FROM m) GROUP BY qa_id),
s AS (SELECT CASE WHEN c.m IS NULL THEN 0.0::DOUBLE ELSE 10 * (m::DOUBLE / len(p)) * (m::DOUBLE / len(r)) / (m::DOUBLE / len(r) + 9 * (m::DOUBLE / len(p))) * (1 - 0.5::DOUBLE * pow(chunks::DOUBLE / m, 3)) END AS s FROM z LEFT JOIN c USING (qa_id))
SELECT round(avg(s), 6) AS meteor FROM s""")
def meteor(spark, d):
    """METEOR by stages: equal words, then equal stems."""
    return r6(E.meteor(english(spark, d)))


TREND = "t AS (SELECT model_name, benchmark, metric, count(*) AS n, arg_min(value, (ts, seq)) AS first_value, arg_max(value, (ts, seq)) AS last_value FROM v_runs GROUP BY ALL HAVING count(*) > 1)"


@query("trend", f"WITH {TREND} SELECT *, round(last_value - first_value, 6) AS change, CASE WHEN last_value > first_value THEN 'improving' WHEN last_value < first_value THEN 'declining' ELSE 'stable' END AS trend FROM t")
def trend(spark, d):
    return E.trends(view(spark, d, "v_runs")).withColumn("change", F.round("change", 6))


@query("degradation", f"WITH {TREND} SELECT model_name, benchmark, metric, round(last_value - first_value, 6) AS change, CASE WHEN last_value - first_value < -1000 THEN 'high' ELSE 'medium' END AS severity FROM t WHERE last_value - first_value < -500")
def degradation(spark, d):
    return r6(E.degradations(view(spark, d, "v_runs"), 500, 1000))


@query("latest_per_model", "SELECT model_name, seq, benchmark, metric, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY ts DESC, seq DESC) AS k FROM v_runs) WHERE k = 1")
def latest_per_model(spark, d):
    return E.latest(view(spark, d, "v_runs"))


@query("leaderboard", "SELECT CAST(row_number() OVER (ORDER BY score DESC, model_name) AS INT) AS rank, * FROM (SELECT model_name, max(value) AS score, count(*) AS n FROM v_runs GROUP BY model_name)")
def leaderboard(spark, d):
    return E.leaderboard(view(spark, d, "v_runs"))


@query("model_compare", """SELECT benchmark, metric, round(avg(value) FILTER (model_name = '1-URGENT'), 6) AS "1-URGENT", round(avg(value) FILTER (model_name = '5-LOW'), 6) AS "5-LOW" FROM v_runs GROUP BY ALL""")
def model_compare(spark, d):
    return r6(E.compare(view(spark, d, "v_runs"), ["1-URGENT", "5-LOW"]))


@query("benchmark_summary", "SELECT benchmark, metric, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, count(*) AS n FROM v_runs GROUP BY ALL")
def benchmark_summary(spark, d):
    return E.summary(view(spark, d, "v_runs")).withColumn("mean", F.round("mean", 6))


@query("benchmark_kpis", "SELECT round(avg(value), 6) AS mean_value, count(*) AS runs, count(DISTINCT model_name) AS models, max(ts) AS last_run, round(count_if(metric = 'm_F') * 100.0::DOUBLE / count(*), 6) AS success_pct FROM v_runs WHERE ts >= DATE '2000-01-01'")
def benchmark_kpis(spark, d):
    runs = view(spark, d, "v_runs").where(F.col("ts") >= F.lit("2000-01-01").cast("date"))
    return r6(runs.agg(F.avg("value").alias("mean_value"), F.count("*").alias("runs"), F.count_distinct("model_name").alias("models"), F.max("ts").alias("last_run"), (F.count_if(F.col("metric") == "m_F") * 100.0 / F.count("*")).alias("success_pct")))


MONTHS = "b AS (SELECT model_name, date_trunc('month', ts) AS month, benchmark, avg(value) AS v FROM v_runs GROUP BY ALL)"


@query("quality_perf_corr", f"""WITH {MONTHS}, j AS (SELECT a.benchmark AS factor, b2.benchmark AS metric, a.v AS x, b2.v AS y FROM b a JOIN b b2 ON a.model_name = b2.model_name AND a.month = b2.month)
SELECT factor, metric, count(*) AS n, round(corr(x, y), 6) AS r, CASE WHEN abs(corr(x, y)) >= 0.7 THEN 'strong' WHEN abs(corr(x, y)) >= 0.5 THEN 'moderate' ELSE 'weak' END AS strength,
 CASE WHEN corr(x, y) > 0 THEN 'positive' WHEN corr(x, y) < 0 THEN 'negative' ELSE 'none' END AS direction FROM j GROUP BY ALL""")
def quality_perf_corr(spark, d):
    monthly = view(spark, d, "v_runs").groupBy("model_name", F.date_trunc("month", "ts").alias("month"), "benchmark").agg(F.avg("value").alias("v"))
    factors = monthly.select("model_name", "month", F.col("benchmark").alias("factor"), F.col("v").alias("x"))
    metrics = monthly.select("model_name", "month", F.col("benchmark").alias("metric"), F.col("v").alias("y"))
    return r6(E.correlations(factors, metrics, ["model_name", "month"]))


#: Two-sided p of Student's t: the tail as an integral of a power of the cosine, by Simpson's rule in 2,000 steps.
TAIL = "list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(cos(a + i * (pi() / 2 - a) / 2000), n - 3))) * (pi() / 2 - a) / 6000"
CORR = f"""{MONTHS}, j AS (SELECT a.benchmark AS factor, b2.benchmark AS metric, a.v AS x, b2.v AS y FROM b a JOIN b b2 ON a.model_name = b2.model_name AND a.month = b2.month),
c AS (SELECT factor, metric, count(*) AS n, round(corr(x, y), 6) AS r FROM j GROUP BY ALL),
q AS (SELECT *, CASE WHEN abs(r) >= 1 THEN 0.0::DOUBLE ELSE atan(abs(r) / sqrt(1 - r * r)) END AS a FROM c),
p AS (SELECT factor, metric, n, r, CASE WHEN n < 3 THEN NULL WHEN abs(r) >= 1 THEN 0.0::DOUBLE ELSE 2 * exp(lgamma((n - 1) / 2.0::DOUBLE) - lgamma((n - 2) / 2.0::DOUBLE)) / sqrt(pi()) * {TAIL} END AS p FROM q)"""


@query("quality_perf_pvalues", f"""WITH {CORR} SELECT factor, metric, n, r, CASE WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.5 THEN 'moderate' ELSE 'weak' END AS strength,
 CASE WHEN r > 0 THEN 'positive' WHEN r < 0 THEN 'negative' ELSE 'none' END AS direction, round(p, 6) AS p, coalesce(p < 0.05, FALSE) AS significant FROM p""")
def quality_perf_pvalues(spark, d):
    return r6(E.with_p(quality_perf_corr(spark, d)))


@query("quality_recommendations", f"""WITH {CORR}, s AS (SELECT factor, metric, r, row_number() OVER (ORDER BY abs(r) DESC, factor, metric) AS rank FROM p WHERE p < 0.05)
SELECT CAST(rank AS INT) AS rank, factor, metric, CASE WHEN r > 0 THEN 'Improve ' || factor || ' to enhance ' || metric || ' (' || CASE WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.5 THEN 'moderate' ELSE 'weak' END || ' positive correlation: ' || format('{{:.3f}}', r) || ')'
 ELSE 'Address ' || factor || ' issues to improve ' || metric || ' (strong negative correlation: ' || format('{{:.3f}}', r) || ')' END AS text FROM s WHERE rank <= 5""")
def quality_recommendations(spark, d):
    """What to improve first, by significant correlations."""
    return E.recommendations(E.with_p(quality_perf_corr(spark, d)))


@query("quality_impacts", f"""WITH {CORR}, i AS (SELECT DISTINCT factor, length(factor) / 10.0::DOUBLE AS improvement FROM c)
SELECT factor, metric, round(improvement * r, 6) AS expected, round(1 - p, 6) AS confidence, abs(r) AS strength, round(improvement * r * (1 - p), 6) AS priority FROM p JOIN i USING (factor) WHERE p < 0.05""")
def quality_impacts(spark, d):
    """Expected changes of metrics from improvements of factors, with their priority."""
    found = E.with_p(quality_perf_corr(spark, d))
    return r6(E.impacts(found, found.select("factor", (F.length("factor") / 10).alias("improvement")).distinct()))


@query("vote_cross_validation", """SELECT chunk_id, round(avg(s), 6) AS score FROM (SELECT chunk_id, category, max(n)::DOUBLE / sum(n) AS s FROM (SELECT chunk_id, category, lower(value) AS v, count(*) AS n FROM v_votes GROUP BY ALL) GROUP BY ALL) GROUP BY chunk_id""")
def vote_cross_validation(spark, d):
    return r6(E.vote_agreement_modal(view(spark, d, "v_votes")))


@query("vote_ensemble", """SELECT chunk_id, category, value, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id, category ORDER BY round(weight, 9) DESC, first) AS k
FROM (SELECT chunk_id, category, value, sum(confidence) AS weight, min(classifier) AS first FROM v_votes GROUP BY ALL)) WHERE k = 1""")
def vote_ensemble(spark, d):
    return r6(E.vote_ensemble(view(spark, d, "v_votes")))


@query("vote_agreement", "SELECT a.chunk_id, avg(CAST(a.value = b.value AS INT)) AS agreement FROM v_votes a JOIN v_votes b ON a.chunk_id = b.chunk_id AND a.category = b.category WHERE a.classifier = 'clf_a' AND b.classifier = 'clf_c' GROUP BY a.chunk_id")
def vote_agreement(spark, d):
    return E.vote_validation(view(spark, d, "v_votes"), "clf_a", "clf_c")


@query("vote_confidence", "SELECT chunk_id, round(coalesce(avg(confidence) FILTER (confidence >= 0.6), 0), 6) AS confidence FROM v_votes GROUP BY chunk_id")
def vote_confidence(spark, d):
    return r6(E.overall_confidence(view(spark, d, "v_votes"), 0.6))
