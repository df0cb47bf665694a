"""Language identification by character language models (operator 4).

One interpolated Kneser-Ney model of order 3 per language, over lower-case texts
whose runs of other characters than letters are one space. Counts of n-grams come
from all labelled texts: tasks count their batches, Spark sums. Each order is an
array of sorted hashes of its n-grams (the hash of 3 characters of 21 bits can be
undone, so none collide), with the languages that have the n-gram and their values,
as many as there are; lookups are binary searches for the distinct n-grams of a
batch of texts.

A text gets the language with the lowest cross-entropy per character. Posteriors
are calibrated with one temperature, and a text can be rejected whose best
cross-entropy is above what ``reject`` of the language's texts have; temperature
and limits come from at most ``calibration`` labelled texts, those with the
smallest hashes of doc_id (a null doc_id is none of them; of repeated ids one row
is). Counts see every labelled text.

No n-gram is dropped. The models go to the tasks in a broadcast if the highest order
has at most ``max_ngrams`` rows of language and n-gram. Above that they stay tables: the distinct n-grams
of the texts are joined to each order's shares and weights, and their costs to the
counts of n-grams by text. Both ways give the same figures.

Null texts and texts without letters are ``und`` with score 0, as is everything if
there is no labelled text. Repeated rows count and come out once each.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import crc_mod, written

NOT_LETTERS = re.compile(r"[\W\d_]+")
BITS = 21
ONE = (1 << BITS) - 1
# Odd factors of a well-known 64-bit finaliser.
HASH_FACTORS = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
PART = 1 << 20  # characters that are counted or scored at a time
UND = "und"


def letters(text: str | None) -> str:
    """Lower-case letters with single spaces between, before and after words; empty without letters."""
    out = NOT_LETTERS.sub(" ", text.lower()).strip() if text else ""
    return f" {out} " if out else ""


def trigrams(text: str) -> np.ndarray:
    """Three characters as a number, for each place of a text of letters; the start is padded with one space."""
    c = np.frombuffer((" " + text).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    return (c[:-2] << np.uint64(2 * BITS)) | (c[1:-1] << np.uint64(BITS)) | c[2:]


def parts(text: str) -> Iterator[np.ndarray]:
    """The trigrams of a text of letters, a part at a time."""
    for at in range(0, len(text), PART):
        yield trigrams(text[:PART]) if not at else trigrams(text[at - 2 : at + PART])[1:]


def _counted(lang: str, held: list[np.ndarray]) -> pd.DataFrame:
    grams, n = np.unique(np.concatenate(held), return_counts=True)
    return pd.DataFrame({"lang": lang, "gram": grams.view(np.int64), "n": n})


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of n-grams per language, of parts of a batch at a time."""
    for b in batches:
        for lang, own in b.groupby("lang", sort=False)["text"]:
            held, size = [], 0
            for text in own:
                for grams in parts(letters(text)):
                    held.append(grams)
                    size += len(grams)
                    if size >= PART:
                        yield _counted(lang, held)
                        held, size = [], 0
            if held:
                yield _counted(lang, held)


def counts(train: DataFrame) -> DataFrame:
    """lang, gram and n over all texts of ``train`` (lang, text)."""
    return train.mapInPandas(_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def mixed(grams: np.ndarray) -> np.ndarray:
    """A 64-bit hash of n-grams. Each step can be undone, so that no two n-grams share one."""
    h = grams.astype(np.uint64)
    for factor in HASH_FACTORS:
        h = (h ^ (h >> np.uint64(33))) * factor
    return h ^ (h >> np.uint64(33))


class HashArray:
    """Values by n-gram and language: sorted hashes, and for each the languages that have it."""

    def __init__(self, per_language: list[tuple[np.ndarray, np.ndarray]]):
        """per_language: n-grams and their values."""
        key = np.concatenate([np.empty(0, np.uint64), *[mixed(k) for k, _ in per_language]])
        value = np.concatenate([np.empty(0), *[v for _, v in per_language]])
        lang = np.repeat(np.arange(len(per_language), dtype=np.int32), [len(k) for k, _ in per_language])
        order = np.lexsort((lang, key))
        self.keys, start = np.unique(key[order], return_index=True)
        self.ends = np.append(start, len(order))
        self.lang, self.value = lang[order], value[order]

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which of the n-grams, language, value) of all that are there."""
        if not len(self.keys):
            return np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0)
        hashes = mixed(grams)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        own = np.flatnonzero(self.keys[at] == hashes)
        low, n = self.ends[at[own]], self.ends[at[own] + 1] - self.ends[at[own]]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        return np.repeat(own, n), self.lang[place], self.value[place]


class Models:
    """A hash array of shares for each order, and of the weights that contexts leave."""

    def __init__(self, languages: list[str], rows: list[tuple[np.ndarray, np.ndarray]]):
        """rows: the trigrams of each language and their counts."""
        self.languages = languages
        per = [self._model(g, n) for g, n in rows]
        vocabulary = max(1, len(np.unique(np.concatenate([p[0] for p in per])))) if per else 1
        self.base = np.array([p[-1] / (vocabulary + 1) for p in per])  # probability of a character never seen
        self.shares = [HashArray([(p[k], p[k + 1]) for p in per]) for k in (0, 2, 5)]
        self.weights = [HashArray([p[k] for p in per]) for k in (4, 7)]
        self.temperature = np.array(1.0)
        self.limits = np.full(len(languages), np.inf)

    @staticmethod
    def _model(grams: np.ndarray, n: np.ndarray):
        """Discounted shares and backoff weights of the three orders of one language."""
        discount = lambda c: 0.75 if not len(c) else max(0.1, (c == 1).sum() / max(1, (c == 1).sum() + 2 * (c == 2).sum()))

        def level(keys, count, context):
            """Shares of keys in their contexts, and the weight each context leaves."""
            d = discount(count)
            c, where = np.unique(context, return_inverse=True)
            total = np.bincount(where, count, len(c))
            kinds = np.bincount(where, minlength=len(c))
            return np.maximum(count - d, 0) / total[where], c, d * kinds / total

        two, one = np.uint64((1 << 2 * BITS) - 1), np.uint64(ONE)
        pt, ct, wt = level(grams, n.astype(float), grams >> np.uint64(BITS))
        bi, cb_count = np.unique(grams & two, return_counts=True)  # continuation counts
        pb, cb, wb = level(bi, cb_count.astype(float), bi >> np.uint64(BITS))
        uni, cu_count = np.unique(bi & one, return_counts=True)
        pu, _, wu = level(uni, cu_count.astype(float), np.zeros(len(uni), np.uint64))
        return uni, pu, bi, pb, (cb, wb), grams, pt, (ct, wt), float(wu[0]) if len(wu) else 1.0

    def log_probability(self, grams: np.ndarray) -> np.ndarray:
        """log2 of the probability of the last character of each trigram, by language."""
        bi, uni = grams & np.uint64((1 << 2 * BITS) - 1), grams & np.uint64(ONE)
        p = np.tile(self.base, (len(grams), 1))
        row, lang, share = self.shares[0].find(uni)
        p[row, lang] += share
        for order, keys in ((1, bi), (2, grams)):
            row, lang, weight = self.weights[order - 1].find(keys >> np.uint64(BITS))
            p[row, lang] *= weight
            row, lang, share = self.shares[order].find(keys)
            p[row, lang] += share
        return np.log2(np.maximum(p, 1e-30))

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy in bits per character by text and language; number of characters."""
        bits, size = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        held, rows, total = [], [], 0

        def flush():
            grams, where = np.unique(np.concatenate(held), return_inverse=True)
            cost = -self.log_probability(grams)
            row = np.repeat(rows, [len(h) for h in held])
            for k in range(cost.shape[1]):
                bits[:, k] += np.bincount(row, cost[where, k], len(texts))

        for k, text in enumerate(texts):
            t = letters(text)
            if not t:
                continue
            size[k] = len(t)
            for grams in parts(t):
                held.append(grams)
                rows.append(k)
                total += len(grams)
                if total >= PART:
                    flush()
                    held, rows, total = [], [], 0
        if held:
            flush()
        return bits / np.maximum(size, 1)[:, None], size

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        """lang_pred, score, entropy and rejected of each text."""
        n = len(texts)
        if not self.languages:
            return pd.DataFrame({"lang_pred": [UND] * n, "score": np.zeros(n), "entropy": np.full(n, np.nan), "rejected": [True] * n})
        return decided(self.languages, self.temperature, self.limits, *self.entropies(texts))


def decided(languages: list[str], temperature: np.ndarray, limits: np.ndarray, h: np.ndarray, size: np.ndarray) -> pd.DataFrame:
    """lang_pred, score, entropy and rejected from entropies by text and language."""
    best = h.argmin(1)
    z = -(h - h.min(1, keepdims=True)) * np.minimum(size, 200)[:, None] * temperature
    score = 1 / np.exp(z).sum(1)
    none = size == 0
    lang = np.where(none, UND, np.array(languages, object)[best])
    lowest = h[np.arange(len(h)), best]
    return pd.DataFrame({"lang_pred": lang, "score": np.where(none, 0.0, score), "entropy": np.where(none, np.nan, lowest), "rejected": none | (lowest > limits[best])})


def _grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of n-grams per text, of parts of a text at a time."""
    for b in batches:
        for row, text in zip(b["row"], b["text"], strict=True):
            for part in parts(letters(text)):
                grams, n = np.unique(part, return_counts=True)
                yield pd.DataFrame({"row": row, "gram": grams.view(np.int64), "n": n})


class Tables:
    """The models as tables, for more n-grams than a broadcast may have."""

    def __init__(self, found: DataFrame):
        """found: lang, gram and n, each lang and gram once."""
        two, one = (1 << 2 * BITS) - 1, ONE
        self.languages = sorted(r.lang for r in found.select("lang").distinct().collect())
        bi = written(found.groupBy("lang", F.col("gram").bitwiseAND(F.lit(two)).alias("gram")).agg(F.count("*").alias("n")))  # continuation counts
        uni = written(bi.groupBy("lang", F.col("gram").bitwiseAND(F.lit(one)).alias("gram")).agg(F.count("*").alias("n")))
        p1, w1 = self._level(uni, F.lit(0).cast("long"))
        free = {r.lang: r.weight for r in w1.collect()}
        vocabulary = max(1, uni.select("gram").distinct().count())
        self.base = [free[x] / (vocabulary + 1) for x in self.languages]
        (p2, w2), (p3, w3) = (self._level(t, F.shiftright("gram", BITS)) for t in (bi, found))
        wide = lambda t, key, value: written(t.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("lang", value))).alias("by")))  # noqa: E731  a row per language at most
        self.shares = [wide(p, "gram", "share") for p in (p1, p2, p3)]
        self.weights = [wide(w, "context", "weight") for w in (w2, w3)]
        self.temperature = np.array(1.0)
        self.limits = np.full(len(self.languages), np.inf)

    @staticmethod
    def _level(table: DataFrame, context: Column) -> tuple[DataFrame, DataFrame]:
        """Discounted shares of n-grams in their contexts, and the weight each context leaves."""
        ones, twos = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
        discount = table.groupBy("lang").agg(F.greatest(F.lit(0.1), ones / F.greatest(F.lit(1).cast("long"), ones + 2 * twos)).alias("d"))
        rows = table.withColumn("context", context)
        left = rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).join(F.broadcast(discount), "lang")
        left = written(left.withColumn("weight", F.col("d") * F.col("kinds") / F.col("total")))
        shares = rows.join(left, ["lang", "context"]).select("lang", "gram", (F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total")).alias("share"))
        return shares, left.select("lang", "context", "weight")

    def scored(self, texts: DataFrame) -> DataFrame:
        """row, h (cross-entropy by language) and size of the texts (row, text) that have letters."""
        two, one = (1 << 2 * BITS) - 1, ONE
        own = written(texts.select("row", "text").mapInPandas(_grams, "row long, gram long, n long"))
        cost = own.select("gram").distinct()
        cost = cost.select("gram", F.col("gram").bitwiseAND(F.lit(one)).alias("k1"), F.col("gram").bitwiseAND(F.lit(two)).alias("k2"), F.shiftright("gram", BITS).alias("c3"))
        cost = cost.withColumn("c2", F.shiftright("k2", BITS))
        for key, name, table in (("k1", "p1", self.shares[0]), ("k2", "p2", self.shares[1]), ("gram", "p3", self.shares[2]), ("c2", "w2", self.weights[0]), ("c3", "w3", self.weights[1])):
            cost = cost.join(table.toDF(key, name), key, "left")
        value = lambda name, lang, none: F.coalesce(F.try_element_at(F.col(name), F.lit(lang)), F.lit(none))
        bits = []
        for lang, base in zip(self.languages, self.base, strict=True):
            p = F.lit(base) + value("p1", lang, 0.0)
            for order in "23":
                p = p * value(f"w{order}", lang, 1.0) + value(f"p{order}", lang, 0.0)
            bits.append(-F.log2(F.greatest(p, F.lit(1e-30))))
        rows = own.join(cost.select("gram", F.array(*bits).alias("cost")), "gram")
        size = F.sum("n") + 1  # a text of letters has one trigram less than characters
        h = F.array(*[F.sum(F.col("n") * F.col("cost")[k]) / size for k in range(len(bits))])
        return rows.groupBy("row").agg(h.alias("h"), size.cast("double").alias("size"))


def calibrate(models: Models | Tables, train: DataFrame, calibration: int, reject: float) -> None:
    """Temperature and limits from at most ``calibration`` labelled texts.

    Their ids are chosen first; then texts are read, and only their entropies, a few
    numbers each, reach the driver.
    """
    known = train.where("doc_id IS NOT NULL")
    ids = known.groupBy("doc_id").agg(F.lit(1)).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(calibration)
    sample = known.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("x")).select("doc_id", "x.*")
    if isinstance(models, Tables):
        found = sample.join(models.scored(sample.select(F.col("doc_id").alias("row"), "text")), F.col("row") == F.col("doc_id")).select("doc_id", "lang", "h", "size")
    else:
        shared = train.sparkSession.sparkContext.broadcast(cloudpickle.dumps(models))  # with its class, which tasks may not have

        @F.pandas_udf("h array<double>, size double")
        def entropies(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            own = cloudpickle.loads(shared.value)
            for texts in batches:
                h, size = own.entropies(list(texts))
                yield pd.DataFrame({"h": list(h), "size": size})

        found = sample.select("doc_id", "lang", entropies("text").alias("e")).select("doc_id", "lang", "e.*")
    rows = found.where("size > 0").toPandas().sort_values("doc_id")
    if not len(rows):
        return
    h, size, at = np.stack(rows["h"]), rows["size"].to_numpy(), np.array([models.languages.index(x) for x in rows["lang"]])
    z = -(h - h.min(1, keepdims=True)) * np.minimum(size, 200)[:, None]
    loss = lambda t: (np.log(np.exp(z * t).sum(1)) - (z * t)[np.arange(len(at)), at]).mean()
    models.temperature = np.array(min((0.01 * 1.5**k for k in range(12)), key=loss))
    for k in range(len(models.languages)):
        if (at == k).sum() >= 20:
            models.limits[k] = np.quantile(h[at == k, k], reject)


def fit(train: DataFrame, max_ngrams: int = 3_000_000, calibration: int = 2000, reject: float = 0.995) -> Models | Tables:
    """Models from ``train`` (doc_id, lang, text); tables if there are more than ``max_ngrams`` n-grams."""
    found = written(counts(train.select("lang", "text")))
    if found.count() > max_ngrams:
        models = Tables(found)
    else:
        rows = found.toPandas()
        languages, per = sorted(rows["lang"].unique()), []
        for lang in languages:
            own = rows[rows["lang"] == lang].sort_values("gram")
            per.append((own["gram"].to_numpy().view(np.uint64), own["n"].to_numpy()))
        models = Models(languages, per)
    if models.languages:
        calibrate(models, train, calibration, reject)
    return models


def predictions(docs: DataFrame, models: Models | Tables) -> DataFrame:
    """doc_id, held_out, lang_pred, score, entropy and rejected of every document."""
    if isinstance(models, Tables):
        return _joined(docs, models)
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(models))

    @F.pandas_udf("lang_pred string, score double, entropy double, rejected boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = cloudpickle.loads(shared.value)
        for texts in batches:
            yield own.predict(list(texts))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), by_crc().alias("held_out"), predict(F.col("text").cast("string")).alias("p")).select("doc_id", "held_out", "p.*")


def _joined(docs: DataFrame, models: Tables) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), by_crc().alias("held_out"), F.col("text").cast("string").alias("text"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()))
    languages, temperature, limits = models.languages, models.temperature, models.limits

    @F.pandas_udf("lang_pred string, score double, entropy double, rejected boolean")
    def decide(h: pd.Series, size: pd.Series) -> pd.DataFrame:
        return decided(languages, temperature, limits, np.stack(h.to_list()) if len(h) else np.zeros((0, len(languages))), size.to_numpy())

    none = F.array(*[F.lit(0.0)] * len(languages))
    found = rows.drop("text").join(models.scored(rows), "row", "left")
    found = found.select("doc_id", "held_out", decide(F.coalesce("h", none), F.coalesce("size", F.lit(0.0))).alias("p"))
    return found.select("doc_id", "held_out", "p.*")


def by_crc() -> Column:
    """Held out: crc32 of the id as text leaves 2 modulo 4."""
    return crc_mod("doc_id", 4) == 2


def identified(docs: DataFrame, held_out: Callable[[], Column] = by_crc) -> DataFrame:
    """Fit on the labelled documents that are not held out, then predict all."""
    train = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    return predictions(docs, fit(train.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))))
