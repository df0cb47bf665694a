"""Model evaluation: classification and generation metrics, trends, votes, correlation.

Runs are long rows: model_name, benchmark, metric, ts, value and a sequence number
that breaks ties in time.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.stemming import stem
from .models import Model, apply


# -- classification ---------------------------------------------------------------


def accuracy(pairs: DataFrame) -> DataFrame:
    """Share of predictions that equal the label."""
    return pairs.agg(F.coalesce(F.avg((F.col("prediction") == F.col("label")).cast("double")), F.lit(0.0)).alias("accuracy"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def confusion(pairs: DataFrame) -> DataFrame:
    """tp, fp and fn of each class seen in labels or predictions."""
    cells = pairs.groupBy("prediction", "label").agg(F.count("*").alias("n"))
    hit = F.col("prediction") == F.col("label")
    kinds = F.when(hit, F.array(F.struct(F.col("label").alias("class"), F.lit("tp").alias("kind")))).otherwise(
        F.array(F.struct(F.col("prediction").alias("class"), F.lit("fp").alias("kind")), F.struct(F.col("label").alias("class"), F.lit("fn").alias("kind")))
    )
    long = cells.select("n", F.explode(kinds).alias("x")).select("x.*", "n")
    count = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k)
    return long.groupBy("class").agg(count("tp"), count("fp"), count("fn"))


def per_class(pairs: DataFrame) -> DataFrame:
    """precision, recall and f1 per class; nothing divided by nothing is zero."""
    out = confusion(pairs).withColumns({"precision": _ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": _ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", _ratio(2 * p * r, p + r))


def macro(pairs: DataFrame) -> DataFrame:
    return per_class(pairs).agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")])


def binary(pairs: DataFrame, positive: int = 1) -> DataFrame:
    out = pairs.agg(*[F.count_if(c).alias(k) for k, c in {
        "tp": (F.col("prediction") == positive) & (F.col("label") == positive), "fp": (F.col("prediction") == positive) & (F.col("label") != positive),
        "fn": (F.col("prediction") != positive) & (F.col("label") == positive), "tn": (F.col("prediction") != positive) & (F.col("label") != positive)}.items()])
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return out.select(p.alias("precision"), r.alias("recall"), _ratio(2 * p * r, p + r).alias("f1"), matthews().alias("mcc"))


def matthews() -> Column:
    """Matthews' correlation from tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    below = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return F.when(below > 0, (tp * tn - fp * fn) / below).otherwise(0.0)


# Classes of benchmark tasks and the words that name them, negative words first.
TASK_WORDS = {
    "cola": ((("unacceptable", 0), ("acceptable", 1)), 0),
    "sst2": ((("negative", 0), ("positive", 1)), 0),
    "mrpc": ((("not_equivalent", 0), ("equivalent", 1)), 0),
    "qqp": ((("not_duplicate", 0), ("duplicate", 1)), 0),
    "rte": ((("not_entailment", 1), ("entailment", 0)), 0),
    "mnli": ((("entailment", 0), ("contradiction", 2), ("neutral", 1)), 1),
}


def parse_answer(answer: Column, task: str) -> Column:
    """The class a model's answer names; the task's default if none."""
    words, default = TASK_WORDS[task]
    out = F.lit(default)
    for word, value in reversed(words):
        out = F.when(F.contains(F.lower(answer), F.lit(word)), value).otherwise(out)
    return out


# The text columns of benchmark tasks, and the split that is evaluated.
TASK_COLUMNS = {
    "cola": ("sentence",), "sst2": ("sentence",), "mrpc": ("sentence1", "sentence2"), "qqp": ("question1", "question2"),
    "mnli": ("premise", "hypothesis"), "qnli": ("question", "sentence"), "rte": ("sentence1", "sentence2"), "wnli": ("sentence1", "sentence2"),
}
TASK_SPLIT = {"mnli": "validation_matched"}


def task_inputs(rows: DataFrame, task: str) -> DataFrame:
    """text and label of a task's rows; pairs are joined by [SEP]."""
    return rows.select(F.concat_ws(" [SEP] ", *TASK_COLUMNS[task]).alias("text"), F.col("label"))


def task_scores(pairs: DataFrame) -> DataFrame:
    """task, n, accuracy, f1 and Matthews' correlation of 0/1 predictions, all from one aggregate; other classes count for accuracy only."""
    p, y = F.col("prediction"), F.col("label")
    cells = {"tp": (p == 1) & (y == 1), "fp": (p == 1) & (y == 0), "fn": (p == 0) & (y == 1), "tn": (p == 0) & (y == 0)}
    out = pairs.groupBy("task").agg(F.count("*").alias("n"), F.avg((p == y).cast("double")).alias("accuracy"), *[F.count_if(c).alias(k) for k, c in cells.items()])
    f1 = _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return out.select("task", "n", "accuracy", f1.alias("f1"), matthews().alias("mcc"))


class Suite(Protocol):
    """A benchmark: its tasks, their rows of text and label, and how a reply names a class."""

    tasks: Sequence[str]

    def load(self, spark: SparkSession, task: str) -> DataFrame: ...

    def parse(self, reply: Column, task: str) -> Column: ...


def evaluated(spark: SparkSession, suite: Suite, model: Model) -> DataFrame:
    """Scores of a model on all tasks of a suite; replies that fail count as wrong."""
    pairs = None
    for task in suite.tasks:
        rows = apply(suite.load(spark, task), F.col("text"), model)
        one = rows.select(F.lit(task).alias("task"), F.coalesce(suite.parse(F.col("reply"), task), F.lit(-1)).alias("prediction"), "label")
        pairs = one if pairs is None else pairs.unionByName(one)
    return task_scores(pairs)


def merged_metrics(results: DataFrame) -> DataFrame:
    """benchmark, task, metric and value of several results: of one metric the last written."""
    return results.groupBy("benchmark", "task", "metric").agg(F.max_by("value", F.struct("ts", "seq")).alias("value"))


# -- generation -------------------------------------------------------------------


WORD = re.compile(r"[^ \t\n\x0b\f\r]+")
OVERLAP = "struct<matches:long,in_prediction:long,in_reference:long>"


def _overlap(a: list[str], b: list[str], n: int) -> tuple[int, int, int]:
    first, second = (Counter(zip(*(w[k:] for k in range(n)), strict=False)) for w in (a, b))
    return sum(min(c, second[g]) for g, c in first.items()), max(0, len(a) - n + 1), max(0, len(b) - n + 1)


def overlaps(prediction: Column, reference: Column, orders: Sequence[int]) -> Column:
    """Per order n: matches, in_prediction and in_reference of n-grams of lower-case words.

    A match counts as often as both texts have it. All is counted in the row: no shuffle.
    """

    def count(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs = ((WORD.findall(x), WORD.findall(y)) for x, y in zip(a, b, strict=True))
        return pd.Series([[dict(zip(("matches", "in_prediction", "in_reference"), _overlap(x, y, n), strict=True)) for n in orders] for x, y in pairs], dtype=object)

    return F.pandas_udf(count, f"array<{OVERLAP}>")(F.lower(X.text(prediction)), F.lower(X.text(reference)))


def bleu(pairs: DataFrame, most: int = 4) -> DataFrame:
    """Corpus BLEU over words: clipped precisions up to ``most`` and the brevity penalty."""
    rows = pairs.select(overlaps(F.col("prediction"), F.col("reference"), range(1, most + 1)).alias("o"))
    total = lambda name, k: F.sum(F.col("o")[k][name])
    out = rows.agg(*[(total("matches", n - 1) / F.nullif(total("in_prediction", n - 1), F.lit(0))).alias(f"p{n}") for n in range(1, most + 1)], total("in_prediction", 0).alias("c"), total("in_reference", 0).alias("r"))
    penalty = F.when(F.col("c") >= F.col("r"), 1.0).otherwise(F.exp(1 - F.col("r") / F.col("c")))
    logs = sum((F.log(F.col(f"p{n}")) for n in range(2, most + 1)), F.log(F.col("p1")))
    zero = F.least(*[F.coalesce(F.col(f"p{n}"), F.lit(0.0)) for n in range(1, most + 1)]) == 0 if most > 1 else F.coalesce("p1", F.lit(0.0)) == 0
    return out.withColumn("brevity", penalty).withColumn("bleu", F.when(zero, 0.0).otherwise(F.col("brevity") * F.exp(logs / most))).drop("c", "r")


def rouge(pairs: DataFrame, *orders: int) -> DataFrame:
    """Mean precision, recall and F of shared n-grams, for each order."""
    rows = pairs.select(overlaps(F.col("prediction"), F.col("reference"), orders).alias("o"))
    means = []
    for k, n in enumerate(orders):
        o = F.col("o")[k]
        p, r = _ratio(o["matches"], o["in_prediction"]), _ratio(o["matches"], o["in_reference"])
        means += [F.avg(c).alias(f"rouge{n}_{name}") for name, c in (("p", p), ("r", r), ("f", _ratio(2 * p * r, p + r)))]
    return rows.agg(*means)


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by one row of the table."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for k, y in enumerate(b, 1):
            last, row[k] = row[k], last + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


def rouge_l(pairs: DataFrame) -> DataFrame:
    """Mean precision, recall and F of longest common subsequences."""
    size = F.pandas_udf(lambda a, b: pd.Series([lcs((x or "").lower().split(), (y or "").lower().split()) for x, y in zip(a, b, strict=True)], dtype="int64"), "long")
    m, p, r = F.col("m"), F.col("np"), F.col("nr")
    rows = pairs.select(size("prediction", "reference").alias("m"), F.size(X.tokens(F.col("prediction"))).alias("np"), F.size(X.tokens(F.col("reference"))).alias("nr"))
    rows = rows.select(_ratio(m, p).alias("p"), _ratio(m, r).alias("r")).withColumn("f", _ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")))
    return rows.agg(*[F.avg(c).alias(f"rougeL_{c}") for c in ("p", "r", "f")])


def meteor_exact(pairs: DataFrame) -> DataFrame:
    """Mean METEOR with exact matches only: weighted F and the penalty of chunks."""

    def one(a: str | None, b: str | None) -> float:
        hyp, ref = (a or "").lower().split(), (b or "").lower().split()
        where: dict[str, list[int]] = {}
        for k in range(len(ref) - 1, -1, -1):
            where.setdefault(ref[k], []).append(k)
        at = [where[x].pop() if where.get(x) else None for x in hyp]
        m = sum(k is not None for k in at)
        if not m:
            return 0.0
        chunks = sum(k is not None and (i == 0 or at[i - 1] is None or at[i - 1] + 1 != k) for i, k in enumerate(at))
        p, r = m / len(hyp), m / len(ref)
        return 10 * p * r / (r + 9 * p) * (1 - 0.5 * (chunks / m) ** 3)

    score = F.pandas_udf(lambda a, b: pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64"), "double")
    return pairs.select(score("prediction", "reference").alias("s")).agg(F.avg("s").alias("meteor"))


NOT_WORD = re.compile("[^a-z0-9]+")


def stemmed(text: str | None) -> list[str]:
    """Runs of a-z and digits in lower case; those of more than three characters as their stems."""
    return [stem(x) if len(x) > 3 else x for x in NOT_WORD.sub(" ", (text or "").lower()).split()]


def rouge_stemmed(pairs: DataFrame, orders: Sequence[int] = (1, 2)) -> DataFrame:
    """Mean precision, recall and F of shared n-grams and of longest common subsequences over stems.

    The mean F of subsequences is the primary score.
    """
    fields = [f"n{n}" for n in orders] + ["nL"]
    kind = ", ".join(f"{f} {OVERLAP.removesuffix('>')}>" for f in fields)

    def count(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = [(stemmed(x), stemmed(y)) for x, y in zip(a, b, strict=True)]
        names = ("matches", "in_prediction", "in_reference")
        found = {f"n{n}": pd.DataFrame([_overlap(x, y, n) for x, y in rows], columns=names, dtype="int64") for n in orders}
        found["nL"] = pd.DataFrame([(lcs(x, y), len(x), len(y)) for x, y in rows], columns=names, dtype="int64")
        return pd.DataFrame({f: found[f].to_dict("records") for f in fields})

    rows = pairs.select(F.pandas_udf(count, kind)("prediction", "reference").alias("o")).select("o.*")
    means = []
    for f in fields:
        p, r = _ratio(F.col(f)["matches"], F.col(f)["in_prediction"]), _ratio(F.col(f)["matches"], F.col(f)["in_reference"])
        means += [F.avg(c).alias(f"rouge{f[1:]}_{name}") for name, c in (("p", p), ("r", r), ("f", _ratio(2 * p * r, p + r)))]
    return rows.agg(*means)


def _paired(hyp: Sequence[tuple[int, str]], ref: Sequence[tuple[int, str]]) -> list[tuple[int, int]]:
    """Places with equal values: the last of one side with the last of the other, and so on."""
    where: dict[str, list[int]] = {}
    for k, x in ref:
        where.setdefault(x, []).append(k)
    return [(i, where[x].pop()) for i, x in reversed(hyp) if where.get(x)]


def _chunks(pairs: Sequence[tuple[int, int]]) -> int:
    """Runs of pairs that go on by one on both sides."""
    ordered = sorted(pairs)
    return sum(k == 0 or (i, j) != (ordered[k - 1][0] + 1, ordered[k - 1][1] + 1) for k, (i, j) in enumerate(ordered))


def _fewest(hyp: Sequence[tuple[int, str]], ref: Sequence[tuple[int, str]], fixed: Sequence[tuple[int, int]], beam: int) -> list[tuple[int, int]]:
    """As many pairs as any alignment has, in few chunks: a search from left to right that keeps the ``beam`` best so far."""
    where: dict[str, list[int]] = {}
    for k, x in ref:
        where.setdefault(x, []).append(k)
    left = Counter(x for _, x in hyp)
    known, states = dict(fixed), [(0, (), frozenset())]  # chunks, pairs, places used
    for i in sorted([*known, *(i for i, _ in hyp)]):
        x = dict(hyp).get(i) if i not in known else None
        if i not in known:
            left[x] -= 1
        new = {}
        for chunks, pairs, used in states:
            options = [known[i]] if i in known else [j for j in where.get(x, ()) if j not in used]
            if i not in known and len(options) <= left[x]:  # another of the same may take its place
                options = [*options, None]
            for j in options or [None]:
                if j is None:
                    new.setdefault(used, (chunks, pairs, used))
                    continue
                more = not pairs or pairs[-1] != (i - 1, j - 1)
                state = (chunks + more, (*pairs, (i, j)), used | {j})
                key = (state[2], j)
                new[key] = min(new.get(key, state), state, key=lambda s: (-len(s[1]), s[0]))
        states = sorted(new.values(), key=lambda s: (s[0] - len(s[1]), s[0]))[:beam]
    best = min(states, key=lambda s: (-len(s[1]), s[0]))[1]
    return [p for p in best if p[0] not in known]


def meteor_score(prediction: str | None, reference: str | None, fewest: bool = False, beam: int = 40) -> float:
    """METEOR of a pair of texts: words aligned where they are equal, then the others where their stems are.

    Of equal words the last are paired first; with ``fewest`` they are paired for few chunks.
    """
    hyp, ref = (prediction or "").lower().split(), (reference or "").lower().split()
    left, right, pairs = list(enumerate(hyp)), list(enumerate(ref)), []
    for value in (str, stem):
        sides = [(k, value(x)) for k, x in left], [(k, value(x)) for k, x in right]
        pairs += _fewest(*sides, pairs, beam) if fewest else _paired(*sides)
        taken, used = {i for i, _ in pairs}, {j for _, j in pairs}
        left, right = [x for x in left if x[0] not in taken], [x for x in right if x[0] not in used]
    if not pairs:
        return 0.0
    m = len(pairs)
    p, r = m / len(hyp), m / len(ref)
    return 10 * p * r / (r + 9 * p) * (1 - 0.5 * (_chunks(pairs) / m) ** 3)


def meteor(pairs: DataFrame, fewest: bool = False) -> DataFrame:
    """Mean METEOR with stages for equal words and equal stems."""
    score = F.pandas_udf(lambda a, b: pd.Series([meteor_score(x, y, fewest) for x, y in zip(a, b, strict=True)], dtype="float64"), "double")
    return pairs.select(score("prediction", "reference").alias("s")).agg(F.avg("s").alias("meteor"))


# -- runs over time ---------------------------------------------------------------

RUN = ["model_name", "benchmark", "metric"]


def trends(runs: DataFrame) -> DataFrame:
    """First and last value, change and direction per model, benchmark and metric with more than one run."""
    when = F.struct("ts", "seq")
    out = runs.groupBy(*RUN).agg(F.count("*").alias("n"), F.min_by("value", when).alias("first_value"), F.max_by("value", when).alias("last_value")).where("n > 1")
    change = F.col("last_value") - F.col("first_value")
    return out.withColumn("change", change).withColumn("trend", F.when(change > 0, "improving").when(change < 0, "declining").otherwise("stable"))


def degradations(runs: DataFrame, threshold: float = 0.05, high: float = 0.1) -> DataFrame:
    """Trends that fell by more than ``threshold``."""
    fell = trends(runs).where(F.col("change") < -threshold)
    return fell.select(*RUN, "change", F.when(F.col("change") < -high, "high").otherwise("medium").alias("severity"))


def latest(runs: DataFrame) -> DataFrame:
    """The latest run of each model."""
    row = F.max_by(F.struct("seq", "benchmark", "metric", "ts", "value"), F.struct("ts", "seq")).alias("x")
    return runs.groupBy("model_name").agg(row).select("model_name", "x.*")


def leaderboard(runs: DataFrame, top: int = 10) -> DataFrame:
    """Best score and runs per model, ranked."""
    best = runs.groupBy("model_name").agg(F.max("value").alias("score"), F.count("*").alias("n")).orderBy(F.col("score").desc(), "model_name").limit(top)
    packed = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "model_name", "n"))).alias("a"))  # top rows
    return packed.select(F.posexplode("a").alias("p", "x")).select((F.col("p") + 1).alias("rank"), "x.model_name", (-F.col("x.s")).alias("score"), "x.n")


def compare(runs: DataFrame, models: list[str]) -> DataFrame:
    """Mean values of chosen models side by side."""
    return runs.where(F.col("model_name").isin(*models)).groupBy("benchmark", "metric").pivot("model_name", models).agg(F.avg("value"))


def summary(runs: DataFrame) -> DataFrame:
    return runs.groupBy("benchmark", "metric").agg(F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("*").alias("n"))


def strength(r: Column) -> Column:
    return F.when(F.abs(r) >= 0.7, "strong").when(F.abs(r) >= 0.5, "moderate").otherwise("weak")


def correlations(factors: DataFrame, metrics: DataFrame, on: list[str]) -> DataFrame:
    """factor, metric, n, r, strength and direction over rows that share ``on``."""
    both = factors.join(metrics, on)
    out = both.groupBy("factor", "metric").agg(F.count("*").alias("n"), F.corr("x", "y").alias("r"))
    return out.withColumns({"strength": strength(F.col("r")), "direction": F.when(F.col("r") > 0, "positive").when(F.col("r") < 0, "negative").otherwise("none")})


def _beta(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    value = d
    for m in range(1, 300):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d)
            c = 1 + step / c
            value *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * value


def p_value(r: float | None, n: int) -> float | None:
    """Two-sided p-value of Pearson's r by Student's t; none below three rows."""
    if r is None or r != r or n < 3:
        return None
    if abs(r) >= 1:
        return 0.0
    t2 = r * r * (n - 2) / (1 - r * r)
    return _beta((n - 2) / (n - 2 + t2), (n - 2) / 2, 0.5)


def with_p(found: DataFrame) -> DataFrame:
    """Correlations with p and significant."""
    p = F.pandas_udf(lambda r, n: pd.Series([p_value(None if x != x else float(x), int(k)) for x, k in zip(r, n, strict=True)], dtype="float64"), "double")
    return found.withColumn("p", p("r", "n")).withColumn("significant", F.coalesce(F.col("p") < 0.05, F.lit(False)))


def recommendations(found: DataFrame, most: int = 5) -> DataFrame:
    """rank, factor, metric and text of the strongest significant correlations, from rows of factor, metric, r, strength and significant.

    A factor that goes with its metric is to be improved, one that goes against it to be addressed.
    """
    best = found.where("significant").orderBy(F.abs("r").desc(), "factor", "metric").limit(most)
    text = F.when(F.col("r") > 0, F.format_string("Improve %s to enhance %s (%s positive correlation: %.3f)", "factor", "metric", "strength", "r")).otherwise(
        F.format_string("Address %s issues to improve %s (strong negative correlation: %.3f)", "factor", "metric", "r")
    )
    ranks = Window.partitionBy(F.lit(0)).orderBy(F.abs("r").desc(), "factor", "metric")  # of ``most`` rows
    return best.select(F.row_number().over(ranks).alias("rank"), "factor", "metric", text.alias("text"))


def impacts(found: DataFrame, improvements: DataFrame) -> DataFrame:
    """factor, metric, expected (improvement times r), confidence (1 - p) and priority (their product) of significant correlations.

    improvements: factor and improvement.
    """
    both = found.where("significant").join(improvements, "factor")
    expected, confidence = F.col("improvement") * F.col("r"), 1 - F.col("p")
    return both.select("factor", "metric", expected.alias("expected"), confidence.alias("confidence"), F.abs("r").alias("strength"), (expected * confidence).alias("priority"))


# -- votes ------------------------------------------------------------------------


def vote_agreement_modal(votes: DataFrame) -> DataFrame:
    """Per chunk: the mean share of each category's most frequent value; 0.5 for one classifier."""
    sizes = votes.groupBy("chunk_id").agg(F.count_distinct("classifier").alias("k"))
    counts = votes.groupBy("chunk_id", "category", F.lower("value").alias("v")).agg(F.count("*").alias("n"))
    shares = counts.groupBy("chunk_id", "category").agg((F.max("n") / F.sum("n")).alias("s")).groupBy("chunk_id").agg(F.avg("s").alias("s"))
    return shares.join(sizes, "chunk_id").select("chunk_id", F.when(F.col("k") == 1, 0.5).otherwise(F.col("s")).alias("score"))


def vote_ensemble(votes: DataFrame) -> DataFrame:
    """Per chunk and category the value with the most confidence; ties to the first classifier."""
    sums = votes.groupBy("chunk_id", "category", "value").agg(F.sum("confidence").alias("weight"), F.min("classifier").alias("first")).where("weight > 0")
    best = F.min_by(F.struct("value", "weight"), F.struct(-F.round("weight", 9), "first")).alias("x")
    return sums.groupBy("chunk_id", "category").agg(best).select("chunk_id", "category", "x.*")


def vote_validation(votes: DataFrame, first: str, second: str) -> DataFrame:
    """Per chunk the share of categories in which two classifiers agree."""
    side = lambda c, name: votes.where(F.col("classifier") == c).select("chunk_id", "category", F.lower(F.trim("value")).alias(name))
    both = side(first, "a").join(side(second, "b"), ["chunk_id", "category"])
    return both.groupBy("chunk_id").agg(F.avg((F.col("a") == F.col("b")).cast("double")).alias("agreement"))


def overall_confidence(votes: DataFrame, threshold: float) -> DataFrame:
    """Per chunk the mean confidence of votes of at least ``threshold``, else 0."""
    return votes.groupBy("chunk_id").agg(F.coalesce(F.avg(F.when(F.col("confidence") >= threshold, F.col("confidence"))), F.lit(0.0)).alias("confidence"))
