"""Queries over dataset quality."""

from pyspark.sql import functions as F

from ..operators import quality as Q
from .catalog import query
from .q_chunking import complexity, flesch, w
from .views import view

#: Words that occur in the tables, in place of the default English lists.
CONFIG = Q.Config(
    semantic={"questions": ("what", "when", "the"), "technical": ("and", "der"), "medical": ("with", "for")},
    demographic={"gender": ("he", "her", "his"), "age": ("the", "of"), "ethnicity": ("and", "en")},
    connectors=("the", "and"), contradictions=("for", "with"),
)


def r6(df, *keep):
    """Doubles to six places."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if not keep or c in keep])


def words_in(c, words):
    return f"len(list_intersect({c}, {list(words)})) > 0"


def has(c, words):
    return " + ".join(f"CAST(contains({c}, '{x}') AS INT)" for x in words)


LEXICAL = f"""lex AS (SELECT CASE WHEN sum(n) > 100 THEN least(1, count(*) / sqrt(sum(n))) ELSE count(*)::DOUBLE / sum(n) END AS lexical_diversity
 FROM (SELECT x, count(*) AS n FROM (SELECT unnest({w('lower(t)')}) AS x FROM (SELECT question AS t FROM v_qa UNION ALL SELECT answer FROM v_qa)) GROUP BY x)),
sem0 AS (SELECT {w('lower(t)')} AS w FROM (SELECT question AS t FROM v_qa UNION ALL SELECT answer FROM v_qa)),
sem1 AS (SELECT unnest([{', '.join(f"count_if({words_in('w', v)})" for v in CONFIG.semantic.values())}, count_if(len(w) > 0)]) AS c FROM sem0),
sem AS (SELECT -sum(CASE WHEN c > 0 THEN c / (SELECT sum(c) FROM sem1) * log2(c / (SELECT sum(c) FROM sem1)) ELSE 0 END) / 2 AS semantic_diversity FROM sem1),
top AS (SELECT CASE WHEN count(*) > 1 THEN -sum(n / t * log2(n / t)) / log2(count(*)) ELSE 0 END AS topic_balance
 FROM (SELECT count(*)::DOUBLE AS n, (SELECT count(*) FROM v_qa)::DOUBLE AS t FROM v_qa GROUP BY category)),
div AS (SELECT *, lexical_diversity * 0.4::DOUBLE + semantic_diversity * 0.4::DOUBLE + topic_balance * 0.2::DOUBLE AS score FROM lex, sem, top)"""
BIAS = f"""b0 AS (SELECT {w("lower(question || ' ' || answer)")} AS w, {w('answer')} AS a FROM v_qa),
b1 AS (SELECT unnest([{', '.join(f"sum(len(list_filter(w, lambda x: x IN {tuple(v)})))" for v in CONFIG.demographic.values())}]) / (SELECT sum(len(w)) FROM b0) AS f FROM b0),
dem AS (SELECT least(stddev_pop(f) / avg(f) / 2, 1) AS demographic_bias FROM b1),
con AS (SELECT 1 - sum((2 * i - n + 1) * c) / (max(n) * sum(c)) AS content_bias, sum((2 * i - n + 1) * c) / (max(n) * sum(c)) AS gini
 FROM (SELECT c::DOUBLE AS c, row_number() OVER (ORDER BY c) - 1 AS i, count(*) OVER () AS n FROM (SELECT count(*) AS c FROM v_qa GROUP BY category))),
rep AS (SELECT least((stddev_pop(len(a)) / avg(len(a)) + stddev_pop(len(list_distinct(a))::DOUBLE / len(a)) / avg(len(list_distinct(a))::DOUBLE / len(a))) / 4, 1) AS representation_bias FROM b0 WHERE len(a) > 0),
bia AS (SELECT *, (demographic_bias + content_bias + representation_bias) / 3 AS score FROM dem, con, rep)"""
DIFFICULTY = f"""dif0 AS (SELECT avg({flesch('question')}) AS question_readability, avg({complexity('question')}) AS question_complexity, avg({flesch('answer')}) AS answer_readability, avg({complexity('answer')}) AS answer_complexity FROM v_qa),
dif1 AS (SELECT *, question_readability * 0.3::DOUBLE + answer_readability * 0.4::DOUBLE + question_complexity * 0.15::DOUBLE + answer_complexity * 0.15::DOUBLE AS overall_difficulty FROM dif0),
dif AS (SELECT *, 1 - abs((1 - overall_difficulty / 100) - 0.45::DOUBLE) AS score FROM dif1)"""
CROSS = f"""t AS (SELECT qa_id, category, list_distinct({w('lower(answer)')}) AS w FROM v_qa),
pr AS (SELECT a.category, len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))) AS j FROM t a JOIN t b ON a.category = b.category AND a.qa_id < b.qa_id),
cc AS (SELECT category, count(*) AS n_pairs, avg(j) AS mean_jaccard, CASE WHEN avg(j) < 0.3 THEN avg(j) / 0.3::DOUBLE WHEN avg(j) > 0.8 THEN 1 - (avg(j) - 0.8::DOUBLE) / 0.2::DOUBLE ELSE 1 END AS consistency FROM pr GROUP BY category)"""
COH = "string_split(lower(answer), '.')"
CONSISTENCY = f"""{CROSS},
s0 AS (SELECT lower(answer) AS l, list_filter({COH}, lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g')) <> '') AS s FROM v_qa),
s1 AS (SELECT l, len(s) AS n, coalesce(list_sum(list_transform(s, lambda x: {has('x', CONFIG.connectors)})), 0) AS link, coalesce(list_sum(list_transform(s, lambda x: {has('x', CONFIG.contradictions)})), 0) AS against FROM s0),
s2 AS (SELECT avg(CASE WHEN n <= 1 THEN 1.0::DOUBLE ELSE greatest(0, least(1, least(1, link / (n - 1)::DOUBLE * 0.5::DOUBLE + 0.5::DOUBLE) * (1 - least(against * 0.1::DOUBLE, 0.5::DOUBLE)))) END) AS answer_coherence,
 greatest(0, 1 - sum(CAST((contains(l, 'yes') AND contains(l, 'no') AND contains(l, 'but')) OR contains(l, 'however') AS INT) + CAST(contains(l, 'always') AND contains(l, 'never') AS INT)
 + CAST(contains(l, 'all') AND contains(l, 'none') AS INT) + CAST(contains(l, 'every') AND contains(l, 'no') AS INT))::DOUBLE / count(*)) AS factual_consistency FROM s1),
co0 AS (SELECT answer_coherence, (SELECT avg(consistency) FROM cc) AS cross_consistency, factual_consistency FROM s2),
con2 AS (SELECT *, len(list_filter([answer_coherence, cross_consistency, factual_consistency], lambda x: x > 0)) / list_sum(list_transform(list_filter([answer_coherence, cross_consistency, factual_consistency], lambda x: x > 0), lambda x: 1 / x)) AS score FROM co0)"""


@query("quality_diversity", f"WITH {LEXICAL} SELECT round(lexical_diversity, 6) AS lexical_diversity, round(semantic_diversity, 6) AS semantic_diversity, round(topic_balance, 6) AS topic_balance, round(score, 6) AS score FROM div")
def quality_diversity(spark, d):
    return r6(Q.diversity(view(spark, d, "v_qa"), CONFIG))


@query("quality_bias", f"WITH {BIAS} SELECT round(demographic_bias, 6) AS demographic_bias, round(content_bias, 6) AS content_bias, round(gini, 6) AS gini, round(representation_bias, 6) AS representation_bias, round(score, 6) AS score, CASE WHEN score < 0.2 THEN 'low' WHEN score < 0.5 THEN 'moderate' ELSE 'high' END AS interpretation FROM bia")
def quality_bias(spark, d):
    return r6(Q.bias(view(spark, d, "v_qa"), CONFIG))


@query("quality_difficulty", f"WITH {DIFFICULTY} SELECT round(question_readability, 6) AS question_readability, round(question_complexity, 6) AS question_complexity, round(answer_readability, 6) AS answer_readability, round(answer_complexity, 6) AS answer_complexity, round(overall_difficulty, 6) AS overall_difficulty, round(score, 6) AS score FROM dif")
def quality_difficulty(spark, d):
    return r6(Q.difficulty(view(spark, d, "v_qa"), CONFIG))


@query("quality_consistency", f"WITH {CONSISTENCY} SELECT round(answer_coherence, 6) AS answer_coherence, round(cross_consistency, 6) AS cross_consistency, round(factual_consistency, 6) AS factual_consistency, round(score, 6) AS score FROM con2")
def quality_consistency(spark, d):
    return r6(Q.consistency(view(spark, d, "v_qa"), CONFIG))


@query("cross_consistency_by_category", f"WITH {CROSS} SELECT category, n_pairs, round(mean_jaccard, 6) AS mean_jaccard, round(consistency, 6) AS consistency FROM cc")
def cross_consistency_by_category(spark, d):
    return r6(Q.cross_consistency(view(spark, d, "v_qa")))


@query("quality_report", f"""WITH {LEXICAL}, {BIAS}, {DIFFICULTY}, {CONSISTENCY},
m AS (SELECT 'diversity' AS metric, score, 0.6::DOUBLE AS threshold FROM div UNION ALL SELECT 'bias', score, 0.3::DOUBLE FROM bia UNION ALL SELECT 'difficulty', score, 0.7::DOUBLE FROM dif UNION ALL SELECT 'consistency', score, 0.8::DOUBLE FROM con2)
SELECT metric, round(score, 6) AS score, threshold, CASE WHEN metric = 'bias' THEN score <= threshold ELSE score >= threshold END AS passed,
 round((SELECT avg(score) FROM m), 6) AS overall, round((SELECT avg(CASE WHEN metric = 'bias' THEN 1 - score ELSE score END) FROM m), 6) AS adjusted, (SELECT avg(score) FROM m) >= 0.5 AS overall_passed FROM m""")
def quality_report(spark, d):
    return r6(Q.report(view(spark, d, "v_qa"), CONFIG))


@query("difficulty_strata", f"""
WITH s AS (SELECT CASE WHEN len({w('question')}) <= 20 THEN 1 WHEN len({w('question')}) <= 50 THEN 2 ELSE 3 END + CASE WHEN len({w('answer')}) <= 10 THEN 1 WHEN len({w('answer')}) <= 30 THEN 2 ELSE 3 END
 + CASE WHEN contains(lower(question), 'tion') OR contains(lower(question), 'ment') THEN 2 ELSE 0 END AS s FROM v_qa)
SELECT CASE WHEN s / 3 <= 1.5 THEN 'easy' WHEN s / 3 <= 2.5 THEN 'medium' ELSE 'hard' END AS difficulty, count(*) AS n FROM s GROUP BY ALL""")
def difficulty_strata(spark, d):
    level = Q.difficulty_level(F.col("question"), F.col("answer"), ("tion", "ment"))
    return view(spark, d, "v_qa").groupBy(level.alias("difficulty")).agg(F.count("*").alias("n"))
