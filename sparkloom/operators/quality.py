"""Dataset quality over question and answer entries.

Entries have question, answer, category and optionally topic; an empty category
counts as missing. Every metric is a handful of aggregates over one pass of row
features, with partial aggregation before the shuffle, and one row as result.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import kept

# Keywords of demographic groups.
DEMOGRAPHIC = {
    "gender": ("man", "woman", "male", "female", "he", "she", "his", "her"),
    "age": ("young", "old", "elderly", "child", "adult", "teenage"),
    "ethnicity": ("race", "ethnic", "cultural", "minority", "majority"),
}
CENTRES = {"easy": 80.0, "intermediate": 45.0, "hard": 15.0}
THRESHOLDS = {"diversity": 0.6, "bias": 0.3, "difficulty": 0.7, "consistency": 0.8}
TILE = 1024
DENSE = 4096  # pairs of rows with a word from which on a column of a matrix is cheaper
MOST_TASKS = 4096


@dataclass(frozen=True)
class Config:
    """Word lists, thresholds and weights of a report."""

    semantic: Mapping[str, Sequence[str]] = field(default_factory=lambda: {"questions": X.QUESTION_WORDS, "technical": X.TECHNICAL_WORDS, "medical": X.MEDICAL_WORDS})
    demographic: Mapping[str, Sequence[str]] = field(default_factory=lambda: DEMOGRAPHIC)
    connectors: Sequence[str] = X.CONNECTORS
    contradictions: Sequence[str] = X.CONTRADICTIONS
    target: str = "intermediate"
    thresholds: Mapping[str, float] = field(default_factory=lambda: THRESHOLDS)
    weights: Mapping[str, float] = field(default_factory=lambda: dict.fromkeys(THRESHOLDS, 1.0))
    passing: float = 0.5


def category(entries: DataFrame, missing: str = "unknown") -> Column:
    """category, else topic, else ``missing``; empty counts as missing."""
    names = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("category", "topic") if c in entries.columns]
    return F.coalesce(*names, F.lit(missing))


def _topic_shares(entries: DataFrame) -> DataFrame:
    """n and total per category."""
    counts = entries.groupBy(category(entries).alias("category")).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total"), F.count("*").alias("k"))))  # one row


def diversity(entries: DataFrame, config: Config = Config()) -> DataFrame:
    """One row: lexical, semantic and topic diversity and their weighted score."""
    texts = entries.select(F.explode(F.array("question", "answer")).alias("t")).select(X.tokens(F.col("t")).alias("w"))
    lexical = texts.select(F.explode("w").alias("x")).groupBy("x").agg(F.count("*").alias("n")).agg(F.count("*").alias("types"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"))
    ratio = F.when(F.col("tokens") > 100, F.col("types") / F.sqrt("tokens")).otherwise(F.col("types") / F.col("tokens"))
    lexical = lexical.select(F.when(F.col("tokens") == 0, 0.0).otherwise(F.least(F.lit(1.0), ratio)).alias("lexical_diversity"))
    hits = texts.agg(*[F.count_if(F.arrays_overlap("w", F.array(*map(F.lit, v)))).alias(k) for k, v in config.semantic.items()], F.count_if(F.size("w") > 0).alias("general"))
    names = [*config.semantic, "general"]
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    share = lambda n: F.when(F.col(n) > 0, F.col(n) / total * F.log2(F.col(n) / total)).otherwise(0.0)
    semantic = hits.select(F.when(total == 0, 0.0).otherwise(-sum((share(n) for n in names[1:]), share(names[0])) / 2).alias("semantic_diversity"))
    p = F.col("n") / F.col("total")
    topics = _topic_shares(entries).agg(F.when(F.max("k") > 1, -F.sum(p * F.log2(p)) / F.log2(F.max("k"))).otherwise(0.0).alias("topic_balance"))
    out = lexical.crossJoin(semantic).crossJoin(topics)  # one row each
    return out.withColumn("score", F.col("lexical_diversity") * 0.4 + F.col("semantic_diversity") * 0.4 + F.col("topic_balance") * 0.2)


def _cv(c: Column) -> Column:
    return F.when(F.avg(c) == 0, 0.0).otherwise(F.stddev_pop(c) / F.avg(c))


def _among(w: Column, names: Sequence[str]) -> Column:
    """How many elements are one of the names."""
    return F.size(F.filter(w, lambda x: x.isin(*names)))


def bias(entries: DataFrame, config: Config = Config()) -> DataFrame:
    """One row: demographic, content and representation bias, their mean, and the Gini index."""
    q, a = X.text(F.col("question")), X.text(F.col("answer"))
    w = X.tokens(F.concat_ws(" ", q, a))
    rows = entries.select(F.size(w).alias("n"), *[_among(w, v).alias(f"g_{k}") for k, v in config.demographic.items()])
    sums = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *[F.coalesce(F.sum(f"g_{k}"), F.lit(0)).alias(f"g_{k}") for k in config.demographic])
    groups = sums.select("n", F.explode(F.array(*[F.col(f"g_{k}") for k in config.demographic])).alias("c"))
    freq = F.col("c") / F.nullif("n", F.lit(0))
    demographic = groups.agg(F.when((F.max("n") == 0) | (F.count("*") <= 1) | (F.sum("c") == 0), 0.0).otherwise(F.least(F.stddev_pop(freq) / F.avg(freq) / 2, F.lit(1.0))).alias("demographic_bias"))
    counts = entries.groupBy(category(entries).alias("c")).agg(F.count("*").alias("n")).agg(F.array_sort(F.collect_list("n")).alias("s"))
    n = F.size("s")
    weighted = F.aggregate(F.transform("s", lambda x, i: (2 * i - n + 1) * x), F.lit(0).cast("long"), lambda acc, x: acc + x)
    gini = weighted / (n * F.aggregate("s", F.lit(0).cast("long"), lambda acc, x: acc + x))
    content = counts.select(F.when(n <= 1, 0.0).otherwise(1 - gini).alias("content_bias"), F.when(n <= 1, 0.0).otherwise(gini).alias("gini"))
    words = X.words(a)
    answers = entries.where(a != "").select(F.size(words).alias("n"), F.when(F.size(words) > 0, F.size(F.array_distinct(words)) / F.size(words)).alias("u"))
    representation = answers.agg(F.least((F.coalesce(_cv(F.col("n")), F.lit(0.0)) + F.coalesce(_cv(F.col("u")), F.lit(0.0))) / 2 / 2, F.lit(1.0)).alias("representation_bias"))
    out = demographic.crossJoin(content).crossJoin(representation)  # one row each
    score = (F.col("demographic_bias") + F.col("content_bias") + F.col("representation_bias")) / 3
    return out.withColumn("score", score).withColumn("interpretation", F.when(score < 0.2, "low").when(score < 0.5, "moderate").otherwise("high"))


def difficulty(entries: DataFrame, config: Config = Config()) -> DataFrame:
    """One row: readability and complexity of questions and answers, and how well they meet the target."""
    rows = entries.select("question", "answer")
    out = rows.agg(*[
        e.alias(f"{c}_{k}")
        for c in ("question", "answer")
        for k, e in (
            ("readability", F.coalesce(F.avg(F.when(F.trim(X.text(F.col(c))) != "", X.flesch(F.col(c)))), F.lit(50.0))),
            ("complexity", F.coalesce(F.avg(X.complexity(F.col(c))), F.lit(0.0))),
        )
    ])
    overall = F.col("question_readability") * 0.3 + F.col("answer_readability") * 0.4 + F.col("question_complexity") * 0.15 + F.col("answer_complexity") * 0.15
    out = out.withColumn("overall_difficulty", overall)
    return out.withColumn("score", 1.0 - F.abs((1.0 - F.col("overall_difficulty") / 100.0) - CENTRES[config.target] / 100.0))


def _expanded(code: np.ndarray, x: np.ndarray, y: np.ndarray, of: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows of ``x`` and ``y`` with one of the codes; rows of a code lie from ``of[code]`` and ``to[code]`` on."""
    nx, ny = of[code + 1] - of[code], to[code + 1] - to[code]
    size = nx * ny
    which = np.repeat(np.arange(len(code)), size)
    k = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
    return x[of[code][which] + k // ny[which]], y[to[code][which] + k % ny[which]]


def _tile(rows: pd.DataFrame) -> pd.DataFrame:
    """Sum of Jaccard similarities and number of pairs between two blocks of answers, or within one.

    Words of many pairs are counted by a product of matrices, those of few pair by pair.
    """
    first, second = (np.flatnonzero(rows["block"].to_numpy() == b) for b in (rows["a"].iloc[0], rows["b"].iloc[0]))
    size, times = rows["w"].map(len).to_numpy(), rows["times"].to_numpy().astype(float)
    ids, codes = np.unique(np.concatenate([np.empty(0, np.int64), *rows["w"]]).astype(np.int64), return_inverse=True)
    row = np.repeat(np.arange(len(rows)), size)
    sides = []
    for part in (first, second):
        at = np.full(len(rows), -1)
        at[part] = np.arange(len(part))
        own = at[row] >= 0
        order = np.argsort(codes[own], kind="stable")
        sides.append((at[row][own][order], codes[own][order]))
    (x, cx), (y, cy) = sides
    of, to = (np.concatenate(([0], np.cumsum(np.bincount(c, minlength=len(ids))))) for c in (cx, cy))
    work = np.diff(of) * np.diff(to)
    shared = np.zeros(len(first) * len(second))
    light = np.flatnonzero((work > 0) & (work <= DENSE))
    cuts = np.flatnonzero(np.diff(np.cumsum(work[light]) // (1 << 20))) + 1
    for some in np.split(light, cuts):
        i, j = _expanded(some, x, y, of, to)
        shared += np.bincount(i * len(second) + j, minlength=len(shared))
    shared = shared.reshape(len(first), len(second))
    heavy = np.flatnonzero(work > DENSE)
    for some in np.split(heavy, range(2048, len(heavy), 2048)):
        place = np.full(len(ids), -1)
        place[some] = np.arange(len(some))
        m = []
        for r, c, n in ((x, cx, len(first)), (y, cy, len(second))):
            m.append(np.zeros((n, len(some)), np.float32))
            there = place[c] >= 0
            m[-1][r[there], place[c[there]]] = 1
        shared += m[0] @ m[1].T
    every = size[first][:, None] + size[second][None, :] - shared
    similar = np.where(every == 0, 1.0, shared / np.maximum(every, 1))
    pairs = times[first][:, None] * times[second][None, :]
    if rows["a"].iloc[0] == rows["b"].iloc[0]:
        pairs = np.triu(pairs, 1) + np.diag(times[first] * (times[first] - 1) / 2)
    return pd.DataFrame({"category": [rows["category"].iloc[0]], "total": [float((similar * pairs).sum())], "pairs": [int(pairs.sum())]})


def cross_consistency(entries: DataFrame, tile: int = TILE) -> DataFrame:
    """category, n_pairs, mean_jaccard and consistency of the answers of each category.

    Answers of the same words are one row with their number; words travel as 64-bit hashes.
    Pairs are never rows: the rest of a category is cut into blocks of about ``tile`` by a
    hash of the words, the same on every try of a task, and a task sums the similarities
    of two blocks. Tiles are dealt to as many partitions as their number asks for. The
    mean over all pairs needs every pair compared: a category of n different answers
    takes n squared comparisons and sends each answer to n / ``tile`` tasks.
    """
    own = entries.where(F.trim(X.text(F.col("answer"))) != "").select(category(entries, "general").alias("category"), F.array_sort(F.array_distinct(X.tokens(F.col("answer")))).alias("w"))
    rows = own.groupBy("category", "w").agg(F.count("*").alias("times")).select("category", F.transform("w", lambda x: F.xxhash64(x)).alias("w"), "times", F.xxhash64("w").alias("h"))
    rows = kept(rows)
    sizes = kept(rows.groupBy("category").agg(F.count("*").alias("n"), (F.floor(F.count("*") / tile) + 1).cast("int").alias("blocks")))
    tiles = sizes.agg(F.sum(F.col("blocks").cast("double") * (F.col("blocks") + 1) / 2)).first()[0] or 1
    rows = rows.join(sizes, "category").withColumn("block", F.pmod("h", "blocks").cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = rows.select("category", "w", "times", "block", others.alias("o")).select("category", "w", "times", "block", F.least("block", "o").alias("a"), F.greatest("block", "o").alias("b"))
    dealt = dealt.repartition(int(min(MOST_TASKS, max(1, tiles))), "category", "a", "b")
    sums = dealt.groupBy("category", "a", "b").applyInPandas(_tile, "category string, total double, pairs long")
    found = sizes.join(sums.groupBy("category").agg(F.sum("total").alias("total"), F.sum("pairs").alias("pairs")), "category")
    mean = F.col("mean_jaccard")
    out = found.select("category", F.col("pairs").alias("n_pairs"), F.when(F.col("pairs") > 0, F.col("total") / F.col("pairs")).alias("mean_jaccard"))
    score = F.when(F.col("n_pairs") == 0, 1.0).when(mean < 0.3, mean / 0.3).when(mean > 0.8, 1.0 - (mean - 0.8) / 0.2).otherwise(1.0)
    return out.withColumn("consistency", score)


def consistency(entries: DataFrame, config: Config = Config()) -> DataFrame:
    """One row: coherence, cross and factual consistency and the harmonic mean of those above zero."""
    a = X.text(F.col("answer"))
    rows = entries.where(a != "")
    own = rows.agg(
        F.coalesce(F.avg(F.when(F.trim(a) != "", X.coherence(a, config.connectors, config.contradictions))), F.lit(0.0)).alias("answer_coherence"),
        F.greatest(F.lit(0.0), 1.0 - F.coalesce(F.sum(X.contradiction_count(a)) / F.count("*"), F.lit(0.0))).alias("factual_consistency"),
    )
    cross = cross_consistency(entries).agg(F.coalesce(F.avg("consistency"), F.lit(1.0)).alias("cross_consistency"))
    out = own.crossJoin(cross)  # one row each
    parts = [F.col(c) for c in ("answer_coherence", "cross_consistency", "factual_consistency")]
    positive = F.filter(F.array(*parts), lambda x: x > 0)
    score = F.size(positive) / F.aggregate(positive, F.lit(0.0), lambda acc, x: acc + 1.0 / x)
    return out.withColumn("score", F.when(F.size(positive) == 0, 0.0).otherwise(score))


#: Metrics of a report by name: functions of entries and a config that give one row with a score.
METRICS: dict[str, Callable[[DataFrame, Config], DataFrame]] = {"diversity": diversity, "bias": bias, "difficulty": difficulty, "consistency": consistency}


def register_metric(name: str, metric: Callable[[DataFrame, Config], DataFrame]) -> None:
    """A metric that reports have from now on; its threshold and weight are 0.5 and 1 unless a config names them."""
    METRICS[name] = metric


def issues(found: DataFrame) -> DataFrame:
    """metric and issue of a report's metrics that did not pass."""
    how = F.when(F.col("metric") == "bias", "above").otherwise("below")
    text = F.format_string("%s score %.3f is %s the threshold %.2f", "metric", "score", how, "threshold")
    return found.where(~F.col("passed")).select("metric", text.alias("issue"))


def report(entries: DataFrame, config: Config = Config()) -> DataFrame:
    """metric, score, threshold, passed, overall and adjusted of the four metrics.

    overall averages bias as it is; adjusted takes one minus bias. Lower bias passes.
    """
    long = None
    for name, metric in METRICS.items():
        one = metric(entries, config).select(F.lit(name).alias("metric"), F.col("score"), F.lit(config.thresholds.get(name, 0.5)).alias("threshold"), F.lit(config.weights.get(name, 1.0)).alias("weight"))
        long = one if long is None else long.unionByName(one)
    lower = F.col("metric") == "bias"
    long = kept(long)  # a row a metric; or overall would compute every metric again
    long = long.withColumn("passed", F.when(lower, F.col("score") <= F.col("threshold")).otherwise(F.col("score") >= F.col("threshold")))
    good = F.when(lower, 1.0 - F.col("score")).otherwise(F.col("score"))
    overall = long.agg((F.sum(F.col("score") * F.col("weight")) / F.sum("weight")).alias("overall"), (F.sum(good * F.col("weight")) / F.sum("weight")).alias("adjusted"))
    return long.drop("weight").crossJoin(F.broadcast(overall)).withColumn("overall_passed", F.col("overall") >= config.passing)  # one row


def difficulty_level(question: Column, answer: Column, hard_words: Sequence[str] = X.HARD_WORDS) -> Column:
    """easy, medium or hard by word counts and hard words."""
    band = lambda n, low, high: F.when(n <= low, 1).when(n <= high, 2).otherwise(3)
    score = band(F.size(X.words(question)), 20, 50) + band(F.size(X.words(answer)), 10, 30) + F.when(X.contains_any(F.lower(X.text(question)), hard_words) > 0, 2).otherwise(0)
    return F.when(score / 3 <= 1.5, "easy").when(score / 3 <= 2.5, "medium").otherwise("hard")
