"""Collocations from word-id suffix arrays (operator 13).

Texts are lower-cased in A-Z and cut at ``BREAKS`` into pieces, pieces at spaces and tabs
into words; phrases never cross a piece. Tasks gather texts of one language into shards
of ``shard_bytes``, number a shard's words, build its suffix array by prefix doubling in
numpy, and read n-gram counts from its LCP intervals. Spark sums the shards' counts by
language and phrase, with its partial aggregation before the shuffle.

Long phrases are rare only as a whole, so counting goes up by length: a phrase that
occurs ``least`` times is made of parts that do. Words, then pairs, that occur as often
set bits of a filter of ``bits`` bits, and the next pass leaves out what has a part
without a bit. False positives only cost rows: every phrase that reaches ``least`` is
counted in full, at any size of the corpus. The filter is all that is collected and
sent to tasks, ``bits`` / 8 bytes at most.

Each candidate (2 to 3 words, ``least`` occurrences) is cut after its first k words;
with a of itself, l and r of its parts the score is floor(1000000 a a / (l r)) in
decimals of 38 digits, the lowest cut counts. A candidate inside a longer one that
occurs at least half as often is dropped.

A null language is ``und``; null and empty texts, and texts of breaks alone, have no
words; repeated rows count once each; ties go by occurrences, then by the phrase's UTF-8
bytes; other columns, whatever their names, are not looked at. An empty table has no rows.
A single text longer than a shard is a shard of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

BREAKS = ".,;:!?\n\x0b\x0c\r"
KIND = np.zeros(256, np.uint8)  # of a byte: 0 part of a word, 1 space, 2 break
KIND[[0x20, 0x09]] = 1
KIND[[ord(c) for c in BREAKS]] = 2
SLICE = 20_000  # rows of a batch handed to Spark
SCORE = "(1000000 * CAST(a AS DECIMAL(16,0)) * CAST(a AS DECIMAL(16,0))) div (CAST(l AS DECIMAL(16,0)) * CAST(r AS DECIMAL(16,0)))"  # counts up to 10^15
COUNTS = "lang string, phrase string, n long"


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Word numbers from 1 in text order, with 0 between pieces and at the end, and the words."""
    joined = pc.binary_join_element_wise(texts.cast(pa.large_string()), pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
    data = np.frombuffer(joined.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] else np.zeros(0, np.uint8)
    kind = KIND[data]
    inside = kind == 0
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(1, np.int64), pa.array([], pa.large_string())
    letters = data[inside]
    letters = letters + ((letters >= 65) & (letters <= 90)).astype(np.uint8) * np.uint8(32)
    bounds = np.concatenate([[0], np.cumsum(ends - starts)])
    found = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(letters)]).dictionary_encode()
    piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
    at = np.arange(len(starts)) + np.cumsum(np.diff(piece, prepend=piece[0]) != 0)
    seq = np.zeros(at[-1] + 2, np.int64)
    seq[at] = found.indices.to_numpy() + 1
    return seq, found.dictionary


def later(x: np.ndarray, k: int) -> np.ndarray:
    """``x`` moved forward by ``k``, zeros behind its end."""
    return np.concatenate([x[k:], np.zeros(min(k, len(x)), x.dtype)])


def suffix_array(seq: np.ndarray, words: int, starts: np.ndarray | None = None) -> np.ndarray:
    """Suffixes (those of ``starts``, else all) ordered by their first ``words`` words at least, by prefix doubling."""
    rank, width = seq, 1
    order = None
    while order is None or width < words:
        last = 2 * width >= words
        key = rank * (int(rank.max()) + 1) + later(rank, width) if width < words else rank
        at = starts if last and starts is not None else np.arange(len(seq))
        order = np.argsort(key[at])
        if not last:
            ordered = key[order]
            rank = np.empty_like(seq)
            rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        order, width = at[order], 2 * width
    return order


def shared_words(seq: np.ndarray, order: np.ndarray, words: int) -> np.ndarray:
    """LCP of each suffix and the one before it, in words, up to ``words``."""
    lcp, alike = np.zeros(len(order), np.int64), np.ones(max(len(order) - 1, 0), bool)
    for k in range(words):
        values = later(seq, k)[order]
        alike = alike & (values[1:] == values[:-1])
        lcp[1:] += alike
    return lcp


def intervals(seq: np.ndarray, order: np.ndarray, lcp: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """First suffix and size of each LCP interval of ``words`` words without a break."""
    heads = np.flatnonzero(lcp < words)
    sizes = np.diff(heads, append=len(order))
    first = order[heads]
    whole = np.all([later(seq, k)[first] > 0 for k in range(words)], axis=0)
    return first[whole], sizes[whole]


def hashes(lang: str, words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word of a language; 0 stands for a break."""
    own, digest = np.uint64(xxhash.xxh64_intdigest(lang.encode())), xxhash.xxh64_intdigest
    found = np.fromiter(map(digest, words.cast(pa.large_binary()).to_pylist()), np.uint64, len(words))
    return np.concatenate([np.zeros(1, np.uint64), mixed(found ^ own)])


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers spread over all places."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * np.uint64(3) + b)


def has(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set."""
    at = h % np.uint64(len(bitmap) * 8)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def shard_counts(lang: str, texts: pa.Array, length: int, bitmap: np.ndarray | None) -> tuple[pa.Array, np.ndarray]:
    """Phrases of ``length`` words of a shard whose shorter parts may all be frequent, and their counts."""
    seq, words = words_of(texts)
    starts = None
    if bitmap is not None:
        h = hashes(lang, words)
        if length == 2:
            seq = np.where(np.concatenate([[False], has(bitmap, h[1:])])[seq], seq, 0)
        else:
            pair = has(bitmap, paired(h[seq], h[later(seq, 1)])) & (seq > 0) & (later(seq, 1) > 0)
            starts = np.flatnonzero(pair & later(pair, 1))
    if starts is None:
        starts = np.flatnonzero(seq)
    if not len(starts):
        return pa.array([], pa.large_string()), np.zeros(0, np.int64)
    order = suffix_array(seq, length, starts)
    first, sizes = intervals(seq, order, shared_words(seq, order, length), length)
    parts = [words.take(pa.array(later(seq, k)[first] - 1)) for k in range(length)]
    return parts[0] if length == 1 else pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())), sizes


def shards(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[tuple[str, pa.Array]]:
    """Texts of one language each, of about ``shard_bytes`` over all languages."""

    def dealt(rows: pa.Table) -> Iterator[tuple[str, pa.Array]]:
        rows = rows.combine_chunks().sort_by("lang")
        langs = rows["lang"].to_numpy()
        cuts = [0, *(np.flatnonzero(langs[1:] != langs[:-1]) + 1), len(langs)]
        for low, high in zip(cuts, cuts[1:]):
            yield str(langs[low]), rows["text"].slice(low, high - low).combine_chunks()

    held, size = [], 0
    for batch in batches:
        batch = pa.table({"lang": batch["lang"].cast(pa.large_string()), "text": batch["text"].cast(pa.large_string())})
        ends = np.cumsum(pc.binary_length(batch["text"]).to_numpy())
        low = 0
        while low < len(ends):
            done = int(ends[low - 1]) if low else 0
            high = max(low + 1, int(np.searchsorted(ends, done + shard_bytes - size, "right")))
            held.append(batch.slice(low, high - low))
            size, low = size + int(ends[high - 1]) - done, high
            if size >= shard_bytes or low < len(ends):
                yield from dealt(pa.concat_tables(held))
                held, size = [], 0
    if held:
        yield from dealt(pa.concat_tables(held))


def counter(length: int, shard_bytes: int, sent) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What counts the phrases of a partition; ``sent`` has the filter of shorter parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = None if sent is None else np.frombuffer(sent.value, np.uint8)
        for lang, texts in shards(batches, shard_bytes):
            phrases, n = shard_counts(lang, texts, length, bitmap)
            for k in range(0, len(n), SLICE):
                part = phrases.slice(k, SLICE)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), part.cast(pa.string()), pa.array(n[k : k + SLICE], pa.int64())], ["lang", "phrase", "n"])

    return run


def filter_of(frequent: DataFrame, length: int, bits: int) -> bytes:
    """A bitmap with the bit of every phrase of ``length`` words set; at most ``bits`` / 64 rows reach the driver."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.table(batch).sort_by("lang").combine_chunks()
            langs = rows["lang"].to_numpy()
            cuts = [0, *(np.flatnonzero(langs[1:] != langs[:-1]) + 1), len(langs)]
            for low, high in zip(cuts, cuts[1:]) if len(langs) else ():
                words = pc.list_flatten(pc.split_pattern(rows["phrase"].slice(low, high - low).combine_chunks(), " "))
                h = hashes(str(langs[low]), words)[1:].reshape(-1, length)
                at = (h[:, 0] if length == 1 else paired(h[:, 0], h[:, 1])) % np.uint64(bits)
                yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((at & np.uint64(63)).astype(np.int32))], ["slot", "bit"])

    found = frequent.select("lang", "phrase").mapInArrow(places, "slot long, bit int")
    rows = written(found.groupBy("slot").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))).toArrow()
    slots = np.zeros(bits // 64, np.int64)
    slots[rows["slot"].to_numpy()] = rows["mask"].to_numpy()
    return slots.astype("<i8").tobytes()


def frequent_phrases(docs: DataFrame, longest: int = 3, least: int = 10, shard_bytes: int = 4 << 20, bits: int = 1 << 26) -> tuple[list[DataFrame], DataFrame]:
    """Tables (lang, phrase, n) of the phrases with ``least`` occurrences, one for each length up to 2 or 3 words,
    and the words of each language in all (lang, total). ``bits`` is a multiple of 64.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    tables, totals, sent = [], None, None
    for length in range(1, longest + 1):
        counted = texts.mapInArrow(counter(length, shard_bytes, sent), COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        often = F.col("n") >= least
        tables.append(written(counted if length == 1 else counted.where(often)))
        if length == 1:
            totals = tables[0].groupBy("lang").agg(F.sum("n").alias("total"))
            tables[0] = tables[0].where(often)
        if length < longest:
            sent = spark.sparkContext.broadcast(filter_of(tables[-1], length, bits))
    return tables, totals


def scored(tables: list[DataFrame]) -> DataFrame:
    """Candidates with their lowest cut: lang, phrase, size (in words), a, l, r, score."""
    candidates = reduce(DataFrame.unionByName, [t.withColumn("size", F.lit(k)) for k, t in enumerate(tables[1:], 2)])
    counts = reduce(DataFrame.unionByName, tables[:-1])
    words = F.split("phrase", " ", -1)
    cuts = candidates.select("lang", "phrase", F.col("n").alias("a"), "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("*", F.array_join(F.slice(words, 1, F.col("k")), " ").alias("left"), F.array_join(F.slice(words, F.col("k") + 1, F.col("size")), " ").alias("right"))
    for side, n in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(side), F.col("n").alias(n)), ["lang", side])
    lowest = F.min(F.struct(F.expr(SCORE).alias("score"), "k", "l", "r")).alias("cut")
    return cuts.groupBy("lang", "phrase", "size", "a").agg(lowest).select("lang", "phrase", "size", "a", "cut.l", "cut.r", "cut.score")


def maximal(candidates: DataFrame, share: int = 50) -> DataFrame:
    """Candidates without those inside a longer one that occurs in ``share`` percent of their places or more."""
    words = F.split("phrase", " ", -1)
    inner = F.explode(F.array(F.array_join(F.slice(words, 1, 2), " "), F.array_join(F.slice(words, 2, 2), " ")))
    covers = candidates.where("size = 3").select("lang", inner.alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    both = candidates.join(covers.withColumn("size", F.lit(2)), ["lang", "phrase", "size"], "left")
    return both.where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))).drop("longer")


def collocations(docs: DataFrame, top: int = 2000, least: int = 10, **options: int) -> DataFrame:
    """The ``top`` phrases of each language by score: lang, rank, phrase, a, l, r, n, score.

    Ranks are taken in parts of a language first, so that no task sorts a whole one.
    """
    tables, totals = frequent_phrases(docs, least=least, **options)
    best = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    rows = maximal(written(scored(tables))).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    return rows.join(F.broadcast(totals), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
