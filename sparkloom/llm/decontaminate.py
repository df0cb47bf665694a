"""Benchmark decontamination with an FM-index per training shard (operator 6).

A shard is what a task holds of the documents at a time. Its words become ids of
the benchmark's vocabulary; runs of words no benchmark text can contain (a word
or a pair of neighbours that no item has) become separators, which loses no
occurrence and keeps the index small. The rest is suffix-sorted, its
Burrows-Wheeler transform goes into a wavelet matrix, all benchmark windows of a
length are searched backwards at once, and the occurrences are located by walking
to sampled suffix positions. Their spans are merged per document.

The benchmark's windows are built by tasks, in blocks of about ``block_chars``
characters, and written to the shared folder. The driver passes the written blocks on
to a broadcast, one after another and unread; a broadcast has at most ``pass_bytes``
of them. A benchmark of more bytes takes more passes: one function takes the texts of a
batch through one broadcast after another and lets go of each before the next, so that
neither the driver nor a task ever holds more than a pass, and texts go to Python once.

Null or wordless documents have no words and no hits; null or wordless items have
no windows; an item with a null id is known by the empty text; items of one id
count once; repeated rows come out once each; an empty benchmark hits nothing.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import packed, with_text, written

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SHARD = 1_000_000  # words that one index holds
SAMPLE = 8  # text positions between sampled suffixes
LOCATED = 500_000  # occurrences located at a time
HITS = "n_words long, spans array<struct<s:long,e:long,cs:long,ce:long>>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words of a text, as UTF-8."""
    return text.encode("utf-8", "replace").translate(TABLE).split() if text else []


class Windows:
    """All windows of a block of benchmark items, as rows of word ids by length."""

    def __init__(self, items: list[tuple[str, str | None]], width: int):
        self.ids: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        pairs: set[tuple[int, int]] = set()
        for item, text in items:
            w = [self.ids.setdefault(x, len(self.ids) + 1) for x in words_of(text)]
            pairs.update(zip(w, w[1:], strict=False))
            for k in range(max(1, len(w) - width + 1) if w else 0):
                found.setdefault(tuple(w[k : k + width]), set()).add(item)
        self.size = len(self.ids) + 1
        self.pairs = np.array(sorted(a * self.size + b for a, b in pairs), np.int64)
        self.shortest = min(map(len, found), default=1)
        by: dict[int, list] = {}
        for window, owners in sorted(found.items()):
            by.setdefault(len(window), []).append((window, sorted(owners)))
        self.by = {n: (np.array([w for w, _ in x], np.int64), [o for _, o in x]) for n, x in by.items()}

    def packed(self) -> bytes:
        return pickle.dumps(vars(self))

    @classmethod
    def unpacked(cls, data: bytes) -> Windows:
        w = cls([], 1)
        vars(w).update(pickle.loads(data))
        return w

    def known(self, pair: np.ndarray) -> np.ndarray:
        """Which of the coded pairs of neighbours some item has."""
        if not len(self.pairs):
            return np.zeros(len(pair), bool)
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return self.pairs[at] == pair


class WaveletMatrix:
    """Rank and access over an array of small numbers, for arrays of queries."""

    def __init__(self, values: np.ndarray, size: int):
        self.levels = []
        for bit in range(max(1, int(size - 1).bit_length()) - 1, -1, -1):
            ones = (values >> bit & 1).astype(bool)
            before = np.concatenate(([0], np.cumsum(ones, dtype=np.int32)))
            zeros = len(values) - int(before[-1])
            self.levels.append((bit, before, zeros))
            values = np.concatenate((values[~ones], values[ones]))

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each c stands before each i."""
        start = np.zeros_like(i)
        for bit, before, zeros in self.levels:
            one = (c >> bit & 1).astype(bool)
            i = np.where(one, zeros + before[i], i - before[i])
            start = np.where(one, zeros + before[start], start - before[start])
        return i - start

    def access(self, i: np.ndarray) -> np.ndarray:
        """The value at each i."""
        out = np.zeros(len(i), np.int64)
        for bit, before, zeros in self.levels:
            one = before[i + 1] > before[i]
            out |= one.astype(np.int64) << bit
            i = np.where(one, zeros + before[i], i - before[i])
        return out


class FMIndex:
    """Over runs of word ids; ``first`` marks where a run starts, each ends in a separator."""

    def __init__(self, tokens: np.ndarray, size: int):
        n = len(tokens)
        ends = tokens == 0
        # separators differ from each other in the order, so that sorting ends with the longest run
        rank = np.where(ends, np.cumsum(ends) - 1, tokens + int(ends.sum()))
        order = np.argsort(rank, kind="stable")
        rank = self._ranks(rank[order], None, order)
        width = 1
        while rank.max(initial=0) < n - 1:
            second = np.full(n, -1)
            second[:-width] = rank[width:]
            order = np.lexsort((second, rank))
            rank = self._ranks(rank[order], second[order], order)
            width *= 2
        before = np.concatenate(([0], tokens[:-1]))[order]
        self.tree = WaveletMatrix(before, size)
        self.less = np.concatenate(([0], np.cumsum(np.bincount(tokens, minlength=size))))
        begins = np.concatenate(([True], ends[:-1]))[order]
        self.sampled = begins | (order % SAMPLE == 0)
        self.at = np.cumsum(self.sampled) - 1
        self.positions = order[self.sampled]

    @staticmethod
    def _ranks(a: np.ndarray, b: np.ndarray | None, order: np.ndarray) -> np.ndarray:
        new = a[1:] != a[:-1]
        if b is not None:
            new |= b[1:] != b[:-1]
        out = np.empty(len(a), np.int64)
        out[order] = np.concatenate(([0], np.cumsum(new)))
        return out

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix range of each row of ids, by backward search."""
        c = patterns[:, -1]
        lo, hi = self.less[c], self.less[c + 1]
        live = np.flatnonzero(lo < hi)
        lo, hi = lo.copy(), hi.copy()
        for k in range(patterns.shape[1] - 2, -1, -1):
            c = patterns[live, k]
            lo[live] = self.less[c] + self.tree.rank(c, lo[live])
            hi[live] = self.less[c] + self.tree.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
        gone = np.ones(len(lo), bool)
        gone[live] = False
        hi[gone] = lo[gone]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: steps back to a sampled one are added."""
        out, todo, at, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), rows, 0
        while len(todo):
            here = self.sampled[at]
            out[todo[here]] = self.positions[self.at[at[here]]] + steps
            todo, at = todo[~here], at[~here]
            c = self.tree.access(at)
            at = self.less[c] + self.tree.rank(c, at)
            steps += 1
        return out


def _kept(ids: np.ndarray, w: Windows) -> np.ndarray:
    """(start, end) of the runs that a window could lie in."""
    if not len(ids):
        return np.empty((0, 2), np.int64)
    joined = (ids[1:] > 0) & (ids[:-1] > 0)
    joined &= w.known(ids[:-1] * w.size + ids[1:])
    cut = np.flatnonzero(~joined) + 1
    start, end = np.concatenate(([0], cut)), np.concatenate((cut, [len(ids)]))
    good = (end - start >= w.shortest) & (ids[start] > 0)
    return np.stack((start[good], end[good]), 1)


def _search(runs: list[tuple[int, int, np.ndarray]], w: Windows) -> Iterator[tuple[int, list[tuple[int, int]], set[str]]]:
    """runs: (row, first word's number, ids). Yields row, merged word spans, items of rows with hits."""
    zero = np.zeros(1, np.int64)
    tokens = np.concatenate([x for _, _, ids in runs for x in (ids, zero)])
    lengths = np.array([len(ids) + 1 for _, _, ids in runs])
    run_of = np.repeat(np.arange(len(runs)), lengths)
    offset = np.cumsum(lengths) - lengths
    index = FMIndex(tokens, w.size)
    cover = np.zeros(len(tokens) + 1, np.int64)
    row_of = np.array([r for r, _, _ in runs])
    items: dict[int, set[str]] = {}
    for n, (patterns, owners) in w.by.items():
        lo, hi = index.search(patterns)
        size = hi - lo
        hit = np.flatnonzero(size)
        step = 0
        while step < len(hit):  # occurrences in parts of bounded size
            upto = step + max(1, int(np.searchsorted(np.cumsum(size[hit[step:]]), LOCATED)))
            part = hit[step:upto]
            which = np.repeat(part, size[part])
            rows = lo[which] + np.arange(len(which)) - np.repeat(np.cumsum(size[part]) - size[part], size[part])
            at = index.locate(rows)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + n, -1)
            pairs = np.unique(row_of[run_of[at]] * len(patterns) + which)
            for row, window in zip((pairs // len(patterns)).tolist(), (pairs % len(patterns)).tolist(), strict=True):
                items.setdefault(row, set()).update(owners[window])
            step = upto
    covered = np.cumsum(cover[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([0], covered.view(np.int8), [0]))))
    spans: dict[int, list[tuple[int, int]]] = {}
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        r = run_of[a]
        base = runs[r][1] - offset[r]
        spans.setdefault(runs[r][0], []).append((int(a + base), int(b + base)))
    for row, found in spans.items():
        yield row, found, items[row]


def _with_chars(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """Word spans with the character positions where they start and end."""
    data = text.encode("utf-8", "replace")
    low = data.translate(TABLE)
    ends, at, chars, last = sorted({k for s, e in spans for k in (s, e - 1)}), {}, 0, 0
    want = iter([*ends, -1])
    k = next(want)
    for n, m in enumerate(WORD.finditer(low)):
        if n == k:
            chars += len(data[last : m.start()].decode("utf-8"))
            width = len(m[0].decode("utf-8"))
            at[n] = (chars, chars + width)
            last = m.start()
            if (k := next(want)) < 0:
                break
    return [(s, e, at[s][0], at[e - 1][1]) for s, e in spans]


def shard_hits(texts: list[str | None], blocks: list[Windows]) -> pd.DataFrame:
    """Hits of every text of a shard; more than SHARD words that could be hit make more indexes."""
    n_words, spans, items = [], [[] for _ in texts], [set() for _ in texts]
    runs: list[list[tuple[int, int, np.ndarray]]] = [[] for _ in blocks]
    held = [0] * len(blocks)

    def flush(k: int) -> None:
        for row, found, names in _search(runs[k], blocks[k]):
            spans[row] += _with_chars(texts[row], found)
            items[row] |= names
        runs[k], held[k] = [], 0

    for row, text in enumerate(texts):
        found = words_of(text)
        n_words.append(len(found))
        for k, w in enumerate(blocks):
            ids = np.fromiter(map(w.ids.get, found, repeat(0)), np.int64, len(found))
            for s, e in _kept(ids, w).tolist():
                runs[k].append((row, s, ids[s:e]))
                held[k] += e - s + 1
            if held[k] >= SHARD:
                flush(k)
    for k in range(len(blocks)):
        if runs[k]:
            flush(k)
    return pd.DataFrame({"n_words": n_words, "spans": [[dict(zip(("s", "e", "cs", "ce"), x, strict=True)) for x in sorted(y)] for y in spans], "items": [sorted(x) for x in items]})


def _loaded(shared: Broadcast, stays: bool) -> list[Windows]:
    """The blocks of a broadcast; what Python keeps of it goes, unless it ``stays``."""
    value = shared.value
    if not stays:
        vars(shared).pop("_value", None)
    return [Windows.unpacked(b) for b in value]


def _hits(shared: list[Broadcast]):
    @F.pandas_udf(HITS)
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        only = _loaded(shared[0], True) if len(shared) == 1 else None
        for texts in batches:
            own = [t if isinstance(t, str) else None for t in texts]
            if only is not None:
                yield shard_hits(own, only)
                continue
            found = None
            for one in shared:
                part = shard_hits(own, _loaded(one, False))
                found = part if found is None else joined_hits(found, part)
            yield found

    return hits.asNondeterministic()  # or a filter on the hits would search every text again


def joined_hits(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """Hits of the same texts in two passes."""
    place = lambda x: (x["s"], x["e"], x["cs"], x["ce"])
    spans = [sorted([*x, *y], key=place) for x, y in zip(a["spans"], b["spans"], strict=True)]
    return pd.DataFrame({"n_words": a["n_words"], "spans": spans, "items": [sorted({*x, *y}) for x, y in zip(a["items"], b["items"], strict=True)]})


def blocks(benchmark: DataFrame, width: int, block_chars: int) -> DataFrame:
    """A written row per block of items: its windows, ready to be searched for."""
    own = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    n = 1 + int(own.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]) // block_chars

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["item", "text"])  # the same on every try of a task
        w = Windows(list(zip(rows["item"], rows["text"], strict=True)), width)
        return pd.DataFrame({"windows": [w.packed()] if w.by else []})

    return written(own.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n))).groupBy("block").applyInPandas(build, "windows binary"))


def passes(written_blocks: DataFrame, pass_bytes: int) -> Iterator[Broadcast]:
    """Broadcasts of blocks, of at most ``pass_bytes`` or one block each; one of none for an empty benchmark."""
    context, held, size, sent = written_blocks.sparkSession.sparkContext, [], 0, False
    for row in written_blocks.toLocalIterator():
        if held and size + len(row.windows) > pass_bytes:
            yield context.broadcast(held)
            held, size, sent = [], 0, True
        held.append(bytes(row.windows))
        size += len(row.windows)
    if held or not sent:
        yield context.broadcast(held)


def with_hits(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_chars: int = 4_000_000, pass_bytes: int = 64_000_000) -> DataFrame:
    """``docs`` with _hits: n_words, spans (of words and characters, in order) and items."""
    found = _hits(list(passes(blocks(benchmark, width, block_chars), pass_bytes)))
    return docs.withColumn("_hits", found(F.col("text").cast("string")))


def covered(spans: Column) -> Column:
    """Words inside the union of ordered spans."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("e"))
    step = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), x["e"] - F.greatest(x["s"], a["e"]))).alias("n"), F.greatest(a["e"], x["e"]).alias("e"))
    return F.aggregate(spans, start, step)["n"]


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, items and spans of every document."""
    hit = with_hits(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, width)
    return hit.select("doc_id", "_hits.n_words", covered(F.col("_hits.spans")).alias("n_hit"), "_hits.items", "_hits.spans")


def decontaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """``docs`` without the characters of hit spans; documents left without words go."""
    hit = with_hits(packed(docs, "text"), benchmark, width)
    spans, text = F.col("_hits.spans"), F.col("text").cast("string")
    start = F.struct(F.lit("").alias("t"), F.lit(0).cast("long").alias("e"))
    step = lambda a, x: F.struct(F.concat(a["t"], F.substring(text, (a["e"] + 1).cast("int"), F.greatest(F.lit(0), (x["cs"] - a["e"]).cast("int")))).alias("t"), F.greatest(a["e"], x["ce"]).alias("e"))
    rest = F.aggregate(spans, start, step, lambda a: F.concat(a["t"], F.substring(text, (a["e"] + 1).cast("int"), F.length(text))))
    left = hit.where((F.size(spans) == 0) | (covered(spans) < F.col("_hits.n_words"))).withColumn("rest", F.when(F.size(spans) > 0, rest))
    return with_text(left, docs, F.size(spans) > 0, F.col("rest"))
