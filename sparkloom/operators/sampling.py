"""Samples, splits and folds with a fixed order in place of chance.

The order is a hash of the key: the same rows give the same sample on any cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import ranked

MODULUS = 4294967296


def hashed(key: str, seed: int = 42) -> Column:
    """A multiplicative hash of a whole-number key, the same in any SQL engine."""
    return F.pmod((F.col(key) + seed) * 2654435761, F.lit(MODULUS))


def spread(n: int, k: int) -> list[int]:
    """Positions of a spread sample of ``k`` of ``n``: first, last and evenly between, gaps filled from the front."""
    if n <= k:
        return list(range(n))
    chosen, slots = {0, n - 1}, k - 2
    for i in range(1, slots + 1):
        at = round(i * (n - 1) / (slots + 1))
        if 0 < at < n - 1:
            chosen.add(at)
    chosen.update([i for i in range(1, n - 1) if i not in chosen][: max(0, k - len(chosen))])
    return sorted(chosen)


def smart(rows: DataFrame, by: str, order: str, k: int = 10, width: int = 1_000_000) -> DataFrame:
    """A spread sample of each group's rows in the order of a whole-number column.

    Positions come from the group's size alone; ranks go by ranges of ``width``.
    """
    sizes = rows.groupBy(by).agg(F.count("*").alias("_n"))
    positions = F.pandas_udf(lambda n: pd.Series([spread(int(x), k) for x in n]), "array<int>")
    wanted = sizes.select(by, F.explode(positions("_n")).alias("_at"))
    numbered = ranked(rows, [F.col(by)], F.floor(F.col(order) / width), [order]).withColumn("_at", (F.col("_rank") - 1).cast("int"))
    return numbered.join(wanted, [by, "_at"], "left_semi").drop("_at", "_rank", "_total")


def positional(rows: DataFrame, by: str, order: str, key: str, k: int, seed: int = 42, width: int = 1_000_000) -> DataFrame:
    """k / 3 rows each of the first 20, middle 60 and last 20 percent of each group, in the order of a whole-number column.

    Positions go by ranges of ``width``; the choice within a stratum is a top-k, which Spark cuts before it shuffles.
    """
    numbered = ranked(rows, [F.col(by)], F.floor(F.col(order) / width), [order])
    at, n = F.col("_rank") - 1, F.col("_total")
    staged = numbered.withColumn("stratum", F.when(at < n * 0.2, "begin").when(at < n * 0.8, "middle").otherwise("end")).drop("_rank", "_total")
    rank = F.row_number().over(Window.partitionBy(by, "stratum").orderBy(hashed(key, seed), key))
    return staged.withColumn("_r", rank).where(F.col("_r") <= k // 3).drop("_r")


def diverse(rows: DataFrame, by: str, key: str, content: str, k: int, candidates: int = 50, seed: int = 42) -> DataFrame:
    """by, key and pick (from 1) of up to k rows per group that are least alike, chosen one after another.

    The first is the first in hash order, each next one that with the least highest
    similarity to those before, ties to hash order. The choice is among each group's
    first ``candidates`` rows in hash order, as defined: a top-k over keys alone, whose
    texts are joined then. Repeated keys are rows of their own.
    """
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    order = [hashed(key, seed), F.col(key)]
    first = rows.select(by, key).withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_r") <= candidates)
    first = rows.select(by, key, content).join(first.select(by, key).distinct(), [by, key], "left_semi")

    def choose(g: pd.DataFrame) -> pd.DataFrame:
        g = g.assign(_h=(g[key] + seed) * 2654435761 % MODULUS).sort_values(["_h", key]).head(candidates)
        words = [set((t or "").lower().split()) for t in g[content]]
        chosen = [0]
        near = [len(words[0] & w) / len(words[0] | w) if words[0] | w else 1.0 for w in words]
        while len(chosen) < min(k, len(words)):
            best = min((i for i in range(len(words)) if i not in chosen), key=lambda i: (near[i], i))
            chosen.append(best)
            near = [max(a, len(words[best] & w) / len(words[best] | w) if words[best] | w else 1.0) for a, w in zip(near, words, strict=True)]
        out = g.iloc[chosen][[by, key]].copy()
        out["pick"] = range(1, len(out) + 1)
        return out

    return first.groupBy(by).applyInPandas(choose, f"{by} {kind[by]}, {key} {kind[key]}, pick int")


def combined(chosen: Sequence[DataFrame], everyone: DataFrame, by: str, key: str, k: int, seed: int = 42) -> DataFrame:
    """by and key of the union of several samples, each row once, cut or filled up to ``k`` a group in hash order.

    Filling takes rows that no sample has.
    """
    own = chosen[0].select(by, key)
    for more in chosen[1:]:
        own = own.unionByName(more.select(by, key))
    own = own.distinct().withColumn("_first", F.lit(0))
    rest = everyone.select(by, key).distinct().join(own, [by, key], "left_anti").withColumn("_first", F.lit(1))
    rank = F.row_number().over(Window.partitionBy(by).orderBy("_first", hashed(key, seed), key))
    return own.unionByName(rest).withColumn("_r", rank).where(F.col("_r") <= k).select(by, key)


def split(rows: DataFrame, key: str, test: float = 0.2, val: float = 0.1, by: str | None = None, seed: int = 42) -> DataFrame:
    """``rows`` with split train, val or test, exact shares overall or per stratum.

    Ranks go by buckets of the hash, so that no task sorts a whole stratum.
    """
    if not 0 <= test < 1 or not 0 <= val < 1 or test + val >= 1:
        raise ValueError("shares must be at least 0 and leave some for training")
    h = hashed(key, seed)
    rows = ranked(rows, [F.col(by)] if by else [], F.floor(h / (MODULUS // 1024)).cast("int"), [h, key])
    n_test, n_val = F.floor(F.col("_total") * test), F.floor(F.col("_total") * val)
    name = F.when(F.col("_rank") <= n_test, "test").when(F.col("_rank") <= n_test + n_val, "val").otherwise("train")
    return rows.withColumn("split", name).drop("_rank", "_total")


def folds(rows: DataFrame, key: str, k: int = 5, group: str | None = None, seed: int = 42) -> DataFrame:
    """``rows`` with fold 0 to k - 1 by hash; all rows of a group share one."""
    h = F.pmod(F.xxhash64(F.col(group), F.lit(seed)), F.lit(k)) if group else F.pmod(F.floor(hashed(key, seed) / 65536), F.lit(k))
    return rows.withColumn("fold", h.cast("int"))


def adversarial(rows: DataFrame, key: str, share: float = 0.1, seed: int = 7) -> DataFrame:
    """The share of rows first in hash order, tagged for a model to rewrite; ranks go by buckets of the hash."""
    h = hashed(key, seed)
    found = ranked(rows, [], F.floor(h / (MODULUS // 1024)).cast("int"), [h, key])
    found = found.where(F.col("_rank") <= F.floor(F.col("_total") * share)).drop("_rank", "_total")
    return found.withColumns({"is_adversarial": F.lit(True), "original_index": F.col(key), "adversarial_type": F.lit("paraphrase")})


def batches(rows: DataFrame, sampled: DataFrame, key: str, size: int, width: int = 1_000_000) -> DataFrame:
    """What is not in the sample, dealt into batches of ``size`` in the order of a whole-number key."""
    rest = rows.join(sampled.select(key).distinct(), key, "left_anti").select(key)
    return ranked(rest, [], F.floor(F.col(key) / width), [key]).select(key, F.floor((F.col("_rank") - 1) / size).cast("int").alias("batch"))


def evaluation_bundle(rows: DataFrame, key: str, k: int = 5, test: float = 0.2, val: float = 0.1, by: str | None = None) -> DataFrame:
    """``rows`` with split and fold."""
    return folds(split(rows, key, test, val, by), key, k)


def ratios(parts: Sequence[float]) -> None:
    """Shares must sum to one."""
    if abs(sum(parts) - 1) > 1e-6:
        raise ValueError(f"shares sum to {sum(parts)}")
