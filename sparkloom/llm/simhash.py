"""SimHash near-duplicate detection by a binary trie self-join (operator 3).

``near_duplicates``: fingerprints of 64 bits over 3-word shingles; two link if at most
``errors`` bits differ; classes are the connected components of the links.

* The distinct fingerprints, not the documents, are joined: copies share one.
  Documents get their class by fingerprint and a salt, so that a fingerprint with
  most of the documents is spread over ``salts`` tasks.
* Two fingerprints with at most 3 differing bits agree on one of any 4 disjoint
  groups of bits. Each fingerprint goes into one bucket per group. A bucket with
  more than ``bucket_rows`` fingerprints is dealt again by 4 groups of its free
  bits, and so on: exact, since every link of a bucket falls in one of its parts.
  At the last level at most 16 bits are free, so that no bucket can pass 2**16.
* In a bucket, pairs of trie nodes are walked together, differing bits add up and
  a pair of nodes is left as soon as they pass ``errors``. A bucket emits each
  fingerprint with its class there, never the pairs.
* Classes of buckets are joined by the smallest document id, from fingerprints to
  bucket classes and back; labels of labels are followed too (pointer doubling), so
  that a chain of n links takes about log2(n) rounds. A key has at most
  ``bucket_rows`` or ``4**levels`` rows there.

Nulls and texts without words have fingerprint zero and link like others. A null
doc_id takes no part in the minimum; a class of nulls only has a null id.
Repeated rows come out once each. An empty table gives no rows.

``deduplicated``: documents whose sets of five-word shingles have a Jaccard similarity
of ``similarity`` or more are near copies; one of each class of them stays.

* Fingerprints have 128 bits here, over distinct shingles. Documents with the same
  words are one node, with the smallest doc_id.
* A pair of similarity s differs in about acos(2s/(1+s))/pi of the bits. A node goes
  into one bucket for each of some sets of bits, drawn once; how many sets of how many
  bits follows from the number of nodes, so that a bucket of unlike nodes has 128 to 256
  and that a pair just at ``similarity`` shares one with probability ``recall``; more
  similar pairs do with more. In a bucket the trie walk leaves pairs of more than
  ``errors`` differing bits. A bucket of more than ``bucket_rows`` nodes is cut into
  blocks, and each two blocks meet in a task of their own, so no pair is left out.
* Only nodes with a partner in their bucket meet their shingles (64 bits each), and
  only once; up to ``SENT`` of their ids go to the texts in a broadcast, more by a join. A
  task then checks the pairs by exact Jaccard similarity, nearest first and none whose
  nodes have already been joined, and emits classes, never pairs.
* That finds most pairs cheaply, not all. The rest are found exactly: two sets of this
  similarity share one of the first ``n - ceil(similarity * n) + 1`` shingles of each, in
  any one order. Shingles of such prefixes that occur in one class only are left, which
  are nearly all; documents of different classes that share one are pairs if their sizes,
  the parities of their shingles by hash value and the number of shared prefix shingles
  allow the similarity (upper bounds, so no pair is lost). These are checked by exact
  Jaccard similarity and join the classes. Common shingles, known from a sample, come
  last in the order.
* Only shingles of at most ``FEW`` documents make rows of pairs, so at most (FEW - 1) / 2
  for a document and shingle. Documents of the others, families of copies that differ
  more, meet in one group for all shingles with the same smallest class, so mostly once;
  a group of more than ``bucket_rows`` documents is cut into blocks as above. Those that
  may be alike by size and parities (as many as a document has shingles) get theirs,
  are compared in the task, and only links that join two classes come out.

There, null and wordless texts are copies of each other; fewer than five words are
one shingle. Rows with a null doc_id stay. Rows that repeat a doc_id are one document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import packed, unpacked, written

CHUNK = 1 << 20  # bytes of text that are split into words at a time
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)
BATCH = 60_000  # fingerprints whose buckets are walked together
PAIRS = 4000  # pairs that are checked before labels are looked at again; nodes with shingles that are held together
SENT = 2_000_000  # ids that a broadcast may have
ORDERED = 8192  # documents from which common shingles are known
COMMON = 1 << 17  # common shingles that go to tasks
MET = 1 << 20  # pairs of a bucket that are looked at together
FEW = 8  # documents of a shingle whose pairs are rows
LEAVES = 64  # pairs of rows that are compared without going deeper


def word_chunks(data: bytes) -> Iterator[list[bytes]]:
    """Words (runs without ASCII white space) of whole texts, a chunk at a time."""
    at, n = 0, len(data)
    while at < n:
        end = min(at + CHUNK, n)
        while end < n and data[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield data[at:end].split()
        at = end


def fingerprint(text: str | None, width: int = 3) -> int:
    """The SimHash of a whole text as an unsigned number."""
    if not text:
        return 0
    hashed, total, ones, tail = xxhash.xxh64_intdigest, 0, np.zeros(64, np.int64), []
    for words in word_chunks(text.encode("utf-8", "replace").translate(LOWER)):
        words = tail + words
        if len(words) >= width:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            n = len(words) - width + 1
            h = np.fromiter((hashed(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[width - 1 :].tolist(), strict=True)), np.uint64, n)
            for k, column in enumerate(h.view(np.uint8).reshape(n, 8).T):
                ones[8 * k : 8 * k + 8] += np.bincount(column, minlength=256) @ BITS
            total += n
            tail = words[len(words) - width + 1 :]
        else:
            tail = words
    if not total:
        return hashed(b" ".join(tail), 42) if tail else 0
    return int(sum(1 << k for k in np.nonzero(2 * ones > total)[0].tolist()))


def _fingerprints(batch: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in batch], np.uint64).view(np.int64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, a signed long with the fingerprint's bits. Ids stay in Spark: a null beside them changes none."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.pandas_udf(_fingerprints, "long")(F.col("text").cast("string")).alias("fp"))


def parts(errors: int, levels: int) -> list[list[int]]:
    """For each level, the masks of its buckets: the bits on which a bucket's rows agree."""
    masks, out = [0], []
    for _ in range(levels):
        masks = [m | sum(1 << b for b in group.tolist()) for m in masks for group in np.array_split([b for b in range(64) if not m >> b & 1], errors + 1)]
        out.append(masks)
    return out


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def buckets(fps: DataFrame, errors: int, bucket_rows: int, levels: int) -> list[DataFrame]:
    """fp and key by level: every pair of at most ``errors`` bits shares a key with others."""
    rows, out = fps.select("fp", F.lit(0).alias("node")), []
    masks = parts(errors, levels)
    for level, own in enumerate(masks):
        first = level == 0
        table = F.array(*[F.lit(_signed(m)).cast("long") for m in own])
        child = F.explode(F.sequence(F.lit(0), F.lit(errors))) if first else F.explode(F.sequence(F.col("node") * (errors + 1), F.col("node") * (errors + 1) + errors))
        rows = rows.select("fp", child.alias("node"))
        rows = rows.select("fp", "node", F.xxhash64(F.lit(level), "node", F.col("fp").bitwiseAND(F.element_at(table, F.col("node") + 1))).alias("key"))
        sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        rows = written(rows.join(sizes, "key"))
        last = level == len(masks) - 1
        out.append(rows.where(F.lit(last) | (F.col("n") <= bucket_rows)).select("fp", "key"))
        rows = rows.where(F.col("n") > bucket_rows).select("fp", "node")
        if last or rows.isEmpty():
            break
    return out


def trie_pairs(fp: np.ndarray, group: np.ndarray, errors: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of one group with at most ``errors`` differing bits; rows are sorted by group, fp.

    fp has a column for every 64 bits. A trie node is a range of the sorted rows. All
    pairs of nodes of a depth are walked at once; small pairs are compared at their leaves.
    """
    fp = fp.reshape(len(fp), -1)
    deepest = 64 * fp.shape[1]
    edge = np.flatnonzero(np.diff(group)) + 1
    lo, hi = np.concatenate(([0], edge)), np.concatenate((edge, [len(fp)]))
    keep = hi - lo > 1
    a0, a1 = lo[keep], hi[keep]
    b0, b1, e = a0, a1, np.zeros(len(a0), np.int16)
    left, right = [], []
    for depth in range(deepest + 1):
        na, nb = a1 - a0, b1 - b0
        small = (na * nb <= LEAVES) if depth < deepest else np.ones(len(na), bool)
        if small.any():
            i, j = _expand(a0[small], na[small], b0[small], nb[small])
            near = (i < j) & (distance(fp[i], fp[j]) <= errors)
            left.append(i[near])
            right.append(j[near])
        a0, a1, b0, b1, e = (x[~small] for x in (a0, a1, b0, b1, e))
        if not len(a0):
            break
        bit = (fp[:, depth // 64] >> np.uint64(63 - depth % 64)) & np.uint64(1)
        ones = np.concatenate(([0], np.cumsum(bit))).astype(np.int64)
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        own = a0 == b0  # a node with itself: its two mixed pairs are the same
        nodes = [(a0, am, b0, bm, e), (am, a1, bm, b1, e), (a0, am, bm, b1, e + 1)]
        other = ~own
        nodes.append((am[other], a1[other], b0[other], bm[other], e[other] + 1))
        a0, a1, b0, b1, e = (np.concatenate(x) for x in zip(*nodes, strict=True))
        live = (a1 > a0) & (b1 > b0) & (e <= errors) & ((a0 != b0) | (a1 - a0 > 1))
        a0, a1, b0, b1, e = (x[live] for x in (a0, a1, b0, b1, e))
    none = np.empty(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of rows of 64-bit columns."""
    return np.bitwise_count(a ^ b).sum(1, dtype=np.int64)


def _expand(a0, na, b0, nb):
    """All index pairs of ranges (a0, na) with (b0, nb)."""
    size = na * nb
    which = np.repeat(np.arange(len(size)), size)
    k = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
    return a0[which] + k // nb[which], b0[which] + k % nb[which]


def classes(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of ``n`` by links i-j."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _whole_buckets(run: Callable[[pd.DataFrame], pd.DataFrame], least: int):
    """For rows sorted by key: whole buckets go to ``run``, at least ``least`` rows at once."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0
        for b in batches:
            held.append(b)
            rows += len(b)
            if rows >= least:
                all_ = pd.concat(held)
                cut = int(np.searchsorted(all_["key"].to_numpy(), all_["key"].iloc[-1]))
                if cut:
                    yield run(all_.iloc[:cut])
                held = [all_.iloc[cut:]]
                rows = len(held[0])
        if rows:
            yield run(pd.concat(held))

    return walk


def _bucket_classes(errors: int):
    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        fp, key = rows["fp"].to_numpy().view(np.uint64), rows["key"].to_numpy()
        order = np.lexsort((fp, key))
        fp, key = fp[order], key[order]
        i, j = trie_pairs(fp, key, errors)
        root = classes(len(fp), i, j)
        linked = np.unique(np.concatenate((i, j)))
        return pd.DataFrame({"fp": fp[linked].view(np.int64), "key": key[linked], "root": fp[root[linked]].view(np.int64)})

    return _whole_buckets(walk, BATCH)


def joined(members: DataFrame) -> DataFrame:
    """node and label: the smallest node reachable; members: node and class, nodes of any type that has an order.

    Every round a node, and the label it has, take the smallest label of the node's
    classes; then a label is replaced by its own label.
    """
    label = written(members.select("node").distinct().withColumn("label", F.col("node")))
    while True:
        low = members.join(label, "node").groupBy("class").agg(F.min("label").alias("low"))
        near = members.join(low, "class").groupBy("node").agg(F.min("low").alias("low")).join(label, "node")
        hooks = near.select(F.explode(F.array(F.struct(F.col("node"), F.col("low")), F.struct(F.col("label").alias("node"), F.col("low")))).alias("h")).select("h.*")
        hooked = written(hooks.groupBy("node").agg(F.min("low").alias("low")).join(label, "node").select("node", F.col("label").alias("was"), F.least("label", "low").alias("label")))
        upper = hooked.select(F.col("node").alias("label"), F.col("label").alias("top"))
        label = written(hooked.join(upper, "label").select("node", F.col("top").alias("label"), (F.col("top") < F.col("was")).alias("moved")))
        if label.where("moved").isEmpty():
            return label.select("node", "label")
        label = label.select("node", "label")


def components(fps: DataFrame, errors: int = 3, bucket_rows: int = 2000, levels: int = 5) -> DataFrame:
    """fp and component_id for distinct fps (fp, first: its smallest doc_id)."""
    members = None
    for rows in buckets(fps, errors, bucket_rows, levels):
        found = rows.repartition("key").sortWithinPartitions("key").mapInPandas(_bucket_classes(errors), "fp long, key long, root long")
        members = found if members is None else members.unionByName(found)
    members = members.select("fp", F.struct("key", "root").alias("class")).join(fps, "fp")
    # fingerprints of null ids only come last and have no id
    node = F.struct(F.col("first").isNull().alias("nameless"), F.col("first").alias("id"), F.col("fp").alias("fp"))
    label = joined(written(members.select(node.alias("node"), "class"))).select("node.fp", F.col("label.id").alias("component_id"))
    return fps.join(label, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))


def near_duplicates(docs: DataFrame, errors: int = 3, bucket_rows: int = 2000, salts: int = 256) -> DataFrame:
    """doc_id, fp and component_id of every document."""
    own = written(fingerprints(docs)).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    heads = own.groupBy("fp", "salt").agg(F.min("doc_id").alias("first"))
    found = components(heads.groupBy("fp").agg(F.min("first").alias("first")), errors, bucket_rows)
    parts = heads.select("fp", "salt").join(found, "fp")
    return own.join(parts, ["fp", "salt"]).select("doc_id", "fp", "component_id")


def hex16(fp: str) -> Column:
    """The 16 lower-case hex digits of a fingerprint."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def shingles(text: str | None, width: int) -> np.ndarray:
    """Distinct shingles of a whole text as rows of two 64-bit hashes."""
    hashed, out, tail = xxhash.xxh3_128_digest, [], []
    for words in word_chunks(text.encode("utf-8", "replace").translate(LOWER) if text else b""):
        words = tail + words
        n = len(words) - width + 1
        if n > 0:
            joined_, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            out.append(b"".join([hashed(joined_[a:b]) for a, b in zip(starts[:n].tolist(), ends[width - 1 :].tolist(), strict=True)]))
        tail = words[max(0, n) :]
    if not out and tail:
        out.append(hashed(b" ".join(tail)))
    h = np.frombuffer(b"".join(out), np.uint64).reshape(-1, 2)
    return h[np.unique(h[:, 0], return_index=True)[1]]


def wide_fingerprint(h: np.ndarray) -> tuple[int, int]:
    """128 bits, as two numbers: those that are set in over half the shingles."""
    ones = np.zeros(128, np.int64)
    for k, column in enumerate(np.ascontiguousarray(h).view(np.uint8).reshape(len(h), 16).T):
        ones[8 * k : 8 * k + 8] = np.bincount(column, minlength=256) @ BITS
    high, low = (int(sum(1 << k for k in np.nonzero(2 * half > len(h))[0].tolist())) for half in (ones[:64], ones[64:]))
    return high, low


def _nodes(width: int):
    @F.pandas_udf("high long, low long, same long")
    def nodes(texts: pd.Series) -> pd.DataFrame:
        rows = np.zeros((len(texts), 3), np.uint64)
        for k, text in enumerate(texts):
            h = shingles(text, width)
            if len(h):
                same = xxhash.xxh64()
                for words in word_chunks(text.encode("utf-8", "replace").translate(LOWER)):
                    same.update(b" ".join(words) + b" ")
                rows[k] = (*wide_fingerprint(h), same.intdigest())
        return pd.DataFrame(rows.view(np.int64), columns=["high", "low", "same"])

    return nodes


def _sets(width: int):
    @F.pandas_udf("binary")
    def sets(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, width)[:, 0].tobytes() for t in texts], dtype=object)

    return sets


def banding(nodes: int, similarity: float, recall: float, seed: int = 3) -> list[tuple[int, int]]:
    """The sets of bits on which buckets agree, as masks of the two halves."""
    agree = 1 - np.arccos(2 * similarity / (1 + similarity)) / np.pi
    bits = max(8, int(np.ceil(np.log2(max(1, nodes) / 256))))
    bands = max(1, int(np.ceil(np.log(1 - recall) / np.log(1 - agree**bits))))
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(bands):
        mask = sum(1 << int(b) for b in rng.choice(128, min(bits, 128), replace=False))
        out.append((_signed(mask >> 64), _signed(mask & ((1 << 64) - 1))))
    return out


def _tiles(blocks: Column) -> Column:
    """Keys under which a row of a bucket of ``blocks`` blocks meets each of them, and its block there (-1: it meets its own); null is one block."""
    block = F.pmod(F.xxhash64("id"), blocks)
    tile = lambda o: F.struct(F.xxhash64("key", F.least(block, o), F.greatest(block, o)).alias("key"), F.when(block == o, F.lit(-1).cast("long")).otherwise(block).alias("side"))
    return F.when(blocks.isNotNull(), F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), tile)).otherwise(F.array(F.struct(F.col("key").alias("key"), F.lit(-1).cast("long").alias("side"))))


def near_buckets(nodes: DataFrame, masks: list[tuple[int, int]], bucket_rows: int) -> DataFrame:
    """key, id, high and low: nodes by bucket, and by two blocks of it where it is large."""
    bands = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for k, (a, b) in enumerate(masks)])
    key = F.explode(F.transform(bands, lambda m: F.xxhash64(m["k"], F.col("high").bitwiseAND(m["a"]), F.col("low").bitwiseAND(m["b"]))))
    rows = nodes.select("id", "high", "low", key.alias("key"))
    large = written(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > bucket_rows).select("key", F.ceil(F.col("n") / bucket_rows).alias("blocks")))
    if large.isEmpty():
        return rows.select("key", "id", "high", "low")
    return rows.join(large, "key", "left").select(F.explode(_tiles(F.col("blocks"))).alias("t"), "id", "high", "low").select("t.key", "id", "high", "low")


def _partnered(errors: int):
    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        """The rows that have a partner within the error budget in their bucket."""
        fp, key, id_ = rows[["high", "low"]].to_numpy().view(np.uint64), rows["key"].to_numpy(), rows["id"].to_numpy()
        order = np.lexsort((fp[:, 1], fp[:, 0], key))
        own = order[np.unique(np.concatenate(trie_pairs(fp[order], key[order], errors)))]
        return pd.DataFrame({"key": key[own], "id": id_[own], "high": fp[own, 0].view(np.int64), "low": fp[own, 1].view(np.int64)})

    return _whole_buckets(walk, BATCH // 4)


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have at least this Jaccard similarity."""
    n = len(a) + len(b)
    if not len(a) or not len(b) or min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common >= similarity * (n - common)


def _verified(errors: int, similarity: float):
    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        """Classes of each bucket's pairs that are alike, nearest pairs first, none whose nodes are joined already."""
        fp, key, id_ = rows[["high", "low"]].to_numpy().view(np.uint64), rows["key"].to_numpy(), rows["id"].to_numpy()
        order = np.lexsort((fp[:, 1], fp[:, 0], key))
        fp, key, id_ = fp[order], key[order], id_[order]
        sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"].to_numpy()[order]]
        i, j = trie_pairs(fp, key, errors)
        near = np.argsort(distance(fp[i], fp[j]), kind="stable")
        i, j = i[near], j[near]
        label, hit = np.arange(len(fp)), np.zeros(len(fp), bool)
        for at in range(0, len(i), PAIRS):
            a, b = i[at : at + PAIRS], j[at : at + PAIRS]
            open_ = label[a] != label[b]
            left, right = [], []
            for x, y in zip(a[open_].tolist(), b[open_].tolist(), strict=True):
                if label[x] != label[y] and alike(sets[x], sets[y], similarity):
                    label[label == max(label[x], label[y])] = min(label[x], label[y])
                    left.append(x)
                    right.append(y)
            hit[left], hit[right] = True, True
        return pd.DataFrame({"node": id_[hit], "key": key[hit], "root": id_[label[hit]]})

    return _whole_buckets(walk, PAIRS)


def _prefix_size(n, similarity: float):
    """How many of a set's ``n`` shingles, in any one order, must hold one of each set that is alike."""
    return n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1


def parities(h: np.ndarray, width: int) -> np.ndarray:
    """Whether the number of hashes of each remainder by ``width``, a power of two, is odd, as bits.

    Two sets differ in at least as many elements as bits. Halves xored are those of half the width.
    """
    return np.packbits((np.bincount((h & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).astype(np.uint8)).view(np.uint64)


def _prefixes(width: int, similarity: float, common: np.ndarray):
    order = np.argsort(common)
    known = common[order]

    @F.pandas_udf("size long, odd array<long>, parity binary, prefix array<long>")
    def prefixes(texts: pd.Series) -> pd.DataFrame:
        """By text: its distinct shingles, the parity of their number for each of 128 hash values and of many, and its first shingles, common ones last."""
        out = []
        for text in texts:
            h = shingles(text, width)[:, 0]
            at = np.searchsorted(known, h)
            late = (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == h) if len(known) else np.zeros(len(h), bool)
            h = np.concatenate((h[~late], h[late][np.argsort(order[at[late]])]))
            odd = parities(h, 128).view(np.int64)
            wide = parities(h, max(128, 1 << (len(h) | 1).bit_length() - 1))
            out.append((len(h), odd, wide.tobytes(), h[: _prefix_size(len(h), similarity)].view(np.int64)))
        return pd.DataFrame(out, columns=["size", "odd", "parity", "prefix"])

    return prefixes


def common_shingles(rows: DataFrame, width: int, nodes: int) -> np.ndarray:
    """Shingles of at least 3 of some ``ORDERED`` documents, rarest first.

    They come last in the order from which prefixes are taken. Any order finds every
    pair, so that the sample changes the cost, never the result.
    """

    @F.pandas_udf("array<long>")
    def sets(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, width)[:, 0].view(np.int64) for t in texts], dtype=object)

    some = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, nodes // ORDERED))) == 0)
    counts = some.select(F.explode(sets("text")).alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n >= 3")
    found = counts.orderBy(F.desc("n"), "h").limit(COMMON).toPandas()
    return found["h"].to_numpy(np.int64)[::-1].view(np.uint64)


def _met(key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs of rows with one key, some at a time; rows are sorted by it."""
    edge = np.flatnonzero(np.diff(key)) + 1
    lo, hi = np.concatenate(([0], edge)), np.concatenate((edge, [len(key)]))
    behind = np.repeat(hi, hi - lo) - np.arange(len(key)) - 1  # a row meets those behind it
    ends, at = np.cumsum(behind), 0
    while at < len(key):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + MET, "right")))
        yield _expand(np.arange(at, to), np.ones(to - at, np.int64), np.arange(at, to) + 1, behind[at:to])
        at = to


def _least(total: np.ndarray, similarity: float) -> np.ndarray:
    """Shingles that two sets of ``total`` together must both have to be alike."""
    return np.ceil(similarity / (1 + similarity) * total - 1e-9).astype(np.int64)


def _sharing(similarity: float):
    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        """Pairs of other classes in a small bucket that may be alike, and how many shingles their prefixes must share."""
        key, id_, label, size = (rows[c].to_numpy() for c in ("key", "id", "label", "size"))
        odd = rows[["odd0", "odd1"]].to_numpy().view(np.uint64)
        rest = size - _prefix_size(size, similarity)
        out = []
        for i, j in _met(key):
            total = size[i] + size[j]
            least = _least(total, similarity)
            may = (label[i] != label[j]) & (np.minimum(size[i], size[j]) >= least)
            i, j, total, least = i[may], j[may], total[may], least[may]
            may = distance(odd[i], odd[j]) <= total - 2 * least
            i, j, least = i[may], j[may], least[may]
            out.append(pd.DataFrame({"a": np.minimum(id_[i], id_[j]), "b": np.maximum(id_[i], id_[j]), "need": least - np.maximum(rest[i], rest[j])}))
        return pd.concat(out)

    return _whole_buckets(walk, PAIRS)


def _may_be_alike(rows: pd.DataFrame, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of other classes in a group that sizes and parities allow to be alike, nearest first."""
    key, label, side, size = (rows[c].to_numpy() for c in ("key", "label", "side", "size"))
    parity = rows["parity"].to_numpy()
    width = np.array([len(p) // 8 for p in parity])
    same = {}
    for w in np.unique(width).tolist():  # parities of this width, and wider ones folded to it
        same[w] = np.zeros((len(rows), w), np.uint64)
        for n in (w, 2 * w):
            at = np.flatnonzero(width == n)
            bits = np.frombuffer(b"".join(parity[at]), np.uint64).reshape(len(at), n)
            same[w][at] = bits if n == w else bits[:, :w] ^ bits[:, w:]
    left, right, far = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for i, j in _met(key):
        total = size[i] + size[j]
        most = total - 2 * _least(total, similarity)  # elements that one of them may have alone
        may = (label[i] != label[j]) & ((side[i] == -1) | (side[i] != side[j])) & (np.abs(size[i] - size[j]) <= most)
        i, j, most = i[may], j[may], most[may]
        narrow = np.minimum(width[i], width[j])  # sizes of which one is at least 0.5 of the other: widths of which one is
        for w in np.unique(narrow).tolist():
            own = np.flatnonzero(narrow == w)
            for part in np.array_split(own, len(own) * w // MET + 1):
                d = distance(same[w][i[part]], same[w][j[part]])
                near = d <= most[part]
                left.append(i[part][near])
                right.append(j[part][near])
                far.append(d[near])
    order = np.argsort(np.concatenate(far), kind="stable")
    return np.concatenate(left)[order], np.concatenate(right)[order]


def _in_groups(similarity: float):
    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        """The rows that may be alike with another of their group."""
        return rows.iloc[np.unique(np.concatenate(_may_be_alike(rows, similarity)))]

    return _whole_buckets(walk, PAIRS)


def _linked(similarity: float):
    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        """Pairs of classes that rows of a group link, none that others have joined already."""
        i, j = _may_be_alike(rows, similarity)
        sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"]]
        label = rows["label"].to_numpy()
        own, left, right = np.unique(label, return_inverse=True)[1], [], []
        for at in range(0, len(i), PAIRS):
            a, b = i[at : at + PAIRS], j[at : at + PAIRS]
            open_ = own[a] != own[b]
            for x, y in zip(a[open_].tolist(), b[open_].tolist(), strict=True):
                if own[x] != own[y] and alike(sets[x], sets[y], similarity):
                    own[own == max(own[x], own[y])] = min(own[x], own[y])
                    left.append(x)
                    right.append(y)
        return pd.DataFrame({"a_label": label[left], "b_label": label[right]}, dtype=np.int64)

    return _whole_buckets(walk, PAIRS // 8)


def _sets_of(rows: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """id and shingles of the documents ``ids`` (doc_id)."""
    asked = written(ids.distinct())
    asked = F.broadcast(asked) if asked.count() <= SENT else asked  # or all texts would be shuffled for a few
    texts = rows.join(asked, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    return written(texts.select(F.col("doc_id").alias("id"), _sets(words)("text").alias("shingles")))


def missed(rows: DataFrame, label: DataFrame, nodes: int, words: int, similarity: float, bucket_rows: int = 500) -> DataFrame:
    """a_label and b_label: links between all classes of ``label`` (node, label) that have documents which are alike."""
    texts = rows.join(F.broadcast(label) if nodes <= SENT else label, F.col("doc_id") == F.col("node")).select(F.col("node").alias("id"), "label", "text")
    heads = texts.select("id", "label", _prefixes(words, similarity, common_shingles(rows, words, nodes))("text").alias("p"))
    heads = written(heads.select("id", "label", "p.size", F.col("p.odd")[0].alias("odd0"), F.col("p.odd")[1].alias("odd1"), "p.parity", "p.prefix"))
    keys = heads.select("label", F.explode("prefix").alias("key")).groupBy("key")
    shared = keys.agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).where("low < high")
    shared = written(shared.select("key", F.when(F.col("n") > FEW, F.col("low")).alias("group")))
    shared = F.broadcast(shared) if shared.count() <= SENT else shared

    met = heads.select("id", "label", "size", "odd0", "odd1", F.explode("prefix").alias("key")).join(shared.where(F.col("group").isNull()), "key")
    met = met.repartition("key").sortWithinPartitions("key").mapInPandas(_sharing(similarity), "a long, b long, need long")
    pairs = written(met.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("need").alias("need")).where("n >= need").select("a", "b"))

    grouped = written(heads.select("id", F.explode("prefix").alias("key")).join(shared.where(F.col("group").isNotNull()), "key").select("id", F.col("group").alias("key")).distinct())
    large = grouped.groupBy("key").agg(F.count("*").alias("n")).select("key", F.when(F.col("n") > bucket_rows, F.ceil(F.col("n") / bucket_rows)).alias("blocks"))
    grouped = grouped.join(large, "key").join(heads.select("id", "label", "size", "parity"), "id")
    grouped = grouped.select(F.explode(_tiles(F.col("blocks"))).alias("t"), "id", "label", "size", "parity").select("t.key", "t.side", "id", "label", "size", "parity")
    grouped = written(grouped.repartition("key").sortWithinPartitions("key").mapInPandas(_in_groups(similarity), grouped.schema))

    sets = _sets_of(rows, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).unionByName(grouped.select(F.col("id").alias("doc_id"))), words)

    @F.pandas_udf("boolean")
    def same(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([alike(np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64), similarity) for s, t in zip(x, y, strict=True)], dtype=bool)

    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    of = lambda c: label.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
    links = both.where(same("x", "y")).select("a", "b").join(of("a"), "a").join(of("b"), "b").select("a_label", "b_label")
    grouped = grouped.join(sets, "id").repartition("key").sortWithinPartitions("key")
    return links.unionByName(grouped.mapInPandas(_linked(similarity), "a_label long, b_label long")).distinct()


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, errors: int = 28, recall: float = 0.95, bucket_rows: int = 2000) -> DataFrame:
    """node and label of documents that stand for all with the same words: doc_id, and the smallest of its class of near copies."""
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    nodes = written(rows.select("doc_id", _nodes(words)("text").alias("n")).select("doc_id", "n.*").groupBy("high", "low", "same").agg(F.min("doc_id").alias("id")))
    count = nodes.count()
    found = near_buckets(nodes, banding(count, similarity, recall), bucket_rows)
    found = written(found.repartition("key").sortWithinPartitions("key").mapInPandas(_partnered(errors), "key long, id long, high long, low long"))
    sets = _sets_of(rows, found.select(F.col("id").alias("doc_id")), words)
    found = found.join(sets, "id").repartition("key").sortWithinPartitions("key")
    found = found.mapInPandas(_verified(errors, similarity), "node long, key long, root long")
    members = written(found.select("node", F.struct("key", "root").alias("class")))
    label = written(nodes.select(F.col("id").alias("node")).distinct().join(joined(members), "node", "left").select("node", F.coalesce("label", "node").alias("label")))
    links = written(missed(rows, label, count, words, similarity))
    if links.isEmpty():
        return label
    members = written(links.select(F.explode(F.array("a_label", "b_label")).alias("node"), F.struct("a_label", "b_label").alias("class")))
    top = joined(members).select(F.col("node").alias("label"), F.col("label").alias("top"))
    return label.join(top, "label", "left").select("node", F.coalesce("top", "label").alias("label"))


def deduplicated(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each class of near copies, that with the smallest doc_id; rows with a null doc_id stay.

    Rows that repeat a kept doc_id are one document and stay once.
    """
    keep = near_copies(docs, words, similarity).where("node = label").select(F.col("node").alias("keep"))
    rows = packed(docs, "doc_id")
    unique = rows.where(F.col("doc_id").isNotNull()).join(keep, F.col("doc_id").cast("long") == F.col("keep"), "left_semi").dropDuplicates(["doc_id"])
    return unpacked(unique.unionByName(rows.where(F.col("doc_id").isNull())), docs.columns)
