"""Exact top-k inner products by block-at-a-time pruning (operator 1).

Vectors become whole numbers floor(scale * x). Rows are dealt into shards; inside a
shard they are ordered by their nearest of some of its own rows and cut into blocks
of neighbouring rows. A block keeps the largest and the smallest value of every
dimension (the maxima of its positive and negative terms) and its rows, the block
forward index. For a query, the summed term maxima bound a block's scores: blocks
are scored in the order of their bounds until the next bound is below the kth score
so far; equal bounds are scored, so that ties are exact. One shard is searched first:
a query's kth score there is where its search of every other shard starts, so that
blocks below it are not scored and rows below it not returned. A window keeps each
query's best of all shards.

Shards and blocks of queries are of bounded size, so no task grows with the data. A
shard's index is sent once to each block of ``part_rows`` queries, and the queries once
to each shard, as numbers of 16 bits where they fit: with n rows and m queries that is
n * m / ``part_rows`` + n * m / ``shard_rows`` vectors, the exchange of an exact search
in blocks.
Missing components of shorter vectors are zero. Vectors that are null or hold nulls
or non-finite components, and rows with a null id, take no part. Repeated rows are
candidates each; queries of one id are one query, with the smallest vector. Scores
past the range of a long stay at its end. Other columns are ignored.
"""

from __future__ import annotations

import io
import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

BLOCK = 64
PIVOTS = 128
WAVE = 4


def usable(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id and v (array of double) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col(vec_id).isNotNull() & v.isNotNull()).where(fine).select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"))


def whole(vectors, scale: float) -> np.ndarray:
    """Rows of floor(scale * x), zero where a vector ends early; Python's integers if a product is past the range of doubles."""
    width = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    with np.errstate(over="ignore"):
        found = np.floor(out * scale)
    if np.isfinite(found).all():
        return found
    exactly = [[int(n) if math.isfinite(n) else math.floor(Fraction(v) * Fraction(scale)) for v, n in zip(*rows)] for rows in zip(out.tolist(), found.tolist())]
    return np.array(exactly, object).reshape(out.shape)


def exact(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether all inner products of the rows fit a double exactly."""
    if a.dtype == object or b.dtype == object:
        return False
    return float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1]) < 2.0**53


def padded(a: np.ndarray, width: int) -> np.ndarray:
    """``a`` with columns of zeros up to ``width``, as doubles or Python's integers."""
    return np.pad(a if a.dtype == object else a.astype(float), ((0, 0), (0, width - a.shape[1])))


def packable(x: np.ndarray) -> np.ndarray:
    """``x`` as numbers of 16 bits where they fit."""
    return x.astype(np.int16) if x.dtype != object and np.abs(x).max(initial=0) < 2**15 else x


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _indexed(scale: float):
    def build(rows: pd.DataFrame) -> pd.DataFrame:
        """A shard's block index as one row."""
        x, ids = whole(list(rows["v"]), scale), rows["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        x, ids = x[order], ids[order]
        largest = max(1, np.abs(x).max(initial=0))
        unit = (x / largest).astype(float)  # neighbours need directions only
        unit = unit / (np.sqrt((unit * unit).sum(1, keepdims=True)) + 1e-300)
        pivots = unit[np.linspace(0, len(x) - 1, min(PIVOTS, len(x))).astype(int)]
        near = unit @ pivots.T
        order = np.lexsort((-near.max(1), near.argmax(1)))
        x, ids = x[order], ids[order]
        edges = np.arange(0, len(x), BLOCK)
        packed = _pack(x=packable(x), ids=ids, high=np.maximum.reduceat(x, edges, 0), low=np.minimum.reduceat(x, edges, 0))
        return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "index": [packed]})

    return build


def _packed_queries(scale: float):
    def build(rows: pd.DataFrame) -> pd.DataFrame:
        x = whole(list(rows["v"]), scale)
        return pd.DataFrame({"part": [rows["part"].iloc[0]], "queries": [_pack(x=packable(x), ids=rows["vec_id"].to_numpy(), floor=rows["floor"].to_numpy(float), floored=rows["floor"].notna().to_numpy())]})

    return build


def search(x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_id: int, bounds: np.ndarray, k: int, floor: float | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best rows (ids, scores) for one query of those that reach ``floor``, and how many blocks were scored."""
    order = np.argsort(-bounds, kind="stable")
    best = np.empty(0, x.dtype), np.empty(0, np.int64)
    at, wave, kth = 0, WAVE, floor
    while at < len(order) and (kth is None or bounds[order[at]] >= kth):
        blocks = order[at : at + wave]
        if kth is not None:
            blocks = blocks[bounds[blocks] >= kth]
        rows = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        rows = rows[rows < len(x)]
        rows = rows[ids[rows] != q_id]
        new = x[rows] @ q
        if kth is not None:
            rows, new = rows[new >= kth], new[new >= kth]
        score, own = np.concatenate((best[0], new)), np.concatenate((best[1], ids[rows]))
        if len(score) > k:
            keep = np.lexsort((own, -score))[:k]
            score, own = score[keep], own[keep]
        best = score, own
        kth = score.min() if len(score) == k else floor
        at, wave = at + wave, min(2 * wave, 64)
    return best[1], best[0], at


def _searched(k: int):
    def run(pair: pd.DataFrame) -> pd.DataFrame:
        index, queries = (np.load(io.BytesIO(pair[c].iloc[0]), allow_pickle=True) for c in ("index", "queries"))
        x, ids, high, low = (index[c] for c in ("x", "ids", "high", "low"))
        q, q_ids, floor, floored = (queries[c] for c in ("x", "ids", "floor", "floored"))
        width = max(x.shape[1], q.shape[1])
        x, high, low, q = (padded(a, width) for a in (x, high, low, q))
        if not exact(x, q):
            x, high, low, q = (np.array([[int(v) for v in row] for row in a], object).reshape(a.shape) for a in (x, high, low, q))
        bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
        out = [search(x, ids, q[n], q_ids[n], bounds[n], k, floor[n] if floored[n] else None)[:2] for n in range(len(q))]
        limits = np.iinfo(np.int64)
        score = [min(max(int(s), limits.min), limits.max) for _, own in out for s in own]
        return pd.DataFrame({"query_id": np.repeat(q_ids, [len(o[0]) for o in out]), "vec_id": np.concatenate([o[0] for o in out]).astype(np.int64), "score": np.array(score, np.int64)})

    return run


def top_k(rows: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, vec_id: str = "vec_id", vector: str = "embedding", shard_rows: int = 16_384, part_rows: int = 4096) -> DataFrame:
    """query_id, rank, vec_id and score: each query's k best other rows."""
    own = usable(rows, vec_id, vector)
    chosen = usable(rows.where(is_query), vec_id, vector).groupBy("vec_id").agg(F.min("v").alias("v"))
    n, m = own.count(), chosen.count()
    shards, parts = 1 + n // shard_rows, 1 + m // part_rows
    dealt = own.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards)).cast("int"))
    index = written(dealt.groupBy("shard").applyInPandas(_indexed(scale), "shard int, index binary"))
    chosen = chosen.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(parts)).cast("int"))

    def searched(some: DataFrame, asked: DataFrame) -> DataFrame:
        queries = asked.groupBy("part").applyInPandas(_packed_queries(scale), "part int, queries binary")
        pairs = some.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(queries, "part")
        return pairs.groupBy("shard", "part").applyInPandas(_searched(k), "query_id long, vec_id long, score long")

    found = searched(index.where("shard = 0"), chosen.withColumn("floor", F.lit(None).cast("double")))
    if shards > 1:
        found = written(found)
        # above 2**53 a double may be more than the score: such floors are lowered by more than it rounds
        floor = F.min("score").cast("double")
        floor = F.when(F.count("*") >= k, F.when(F.abs(floor) < 2.0**53, floor).otherwise(floor - F.abs(floor) * 2.0**-50))
        floors = found.groupBy(F.col("query_id").alias("vec_id")).agg(floor.alias("floor"))
        found = found.unionByName(searched(index.where("shard > 0"), chosen.join(floors, "vec_id", "left")))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
