"""SentencePiece encoding and decoding by a streaming Viterbi search (operator 7).

A text gets the pieces of a model's vocabulary with the highest sum of scores,
ties to the longer last piece; a character no piece has becomes its UTF-8 bytes.
The search reads a text once, from each place forward as far as a piece can begin
there, at most the longest piece's length. It keeps the places pieces have reached and
what lies between them and the last boundary that all their backpointer paths share;
up to that boundary ids are committed. Where no piece can span two characters the
paths always converge, so texts are cut there, and a cut of up to ``CUT`` characters that
occurs again is not searched again: the different ones of some texts go through the same
recurrence side by side, a numpy step for each place and each length of piece, over a trie
of the pieces; longer cuts, and those with characters that no piece has, go through the
stream one by one. What was found for short ones is remembered, for about ``REMEMBERED``.

For a model of merges these are the best-scoring pieces, which need not be those
that replaying the merges gives. Decoding is the exact inverse.

The vocabulary is read on the driver from ``model_path`` and sent with the tasks;
its size is the model's. Null and empty texts have no ids. Repeated rows come out
once each; other columns are left alone.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import packed

REMEMBERED = 250_000  # cuts in a task's table
HELD = 4_000_000  # characters of texts whose cuts are searched together
CUT = 48  # characters of a cut that is remembered
RESULT = "struct<ids:array<int>,round_trip:boolean>"


class Pieces:
    """Vocabulary, scores and byte pieces of a model."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int], hidden: set[int], unknown: int):
        self.byte_ids, self.unknown = byte_ids, unknown
        own = {k for k in byte_ids if k >= 0} | hidden
        self.vocabulary = {p.replace("▁", " "): (scores[k], k) for k, p in reversed(list(enumerate(pieces))) if k not in own and p}
        self.longest = max(map(len, self.vocabulary), default=1)
        usual = [s for s, _ in self.vocabulary.values() if s > -1e8]
        self.fallback = min(usual, default=0.0) - 10
        self.data = [b"" if k in hidden else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        for b, k in enumerate(byte_ids):
            if k >= 0:
                self.data[k] = bytes([b])
        # beginnings of pieces: a search forward stops at the first text that begins none
        self.beginnings = {p[:k]: None for p in self.vocabulary for k in range(1, len(p))} | self.vocabulary
        # cuts: before a space after another character, and around characters that no longer piece has
        inner = {c for p in self.vocabulary if len(p) > 1 for c in p}
        spans = any(" " in p.lstrip(" ") for p in self.vocabulary)
        within = "".join(sorted(map(re.escape, inner - {" "})))
        self.cuts = re.compile(r"(?s).+" if spans or not within else rf"(?s) *[{within}]+| +|.")
        self._trie()
        self.memo: dict[str, bytes] = {}
        self.odd: set[str] = set()  # cuts that do not decode to themselves

    def _trie(self) -> None:
        """The pieces as arrays: sorted edges (node and letter as one number), where they lead, and each node's score and piece."""
        letters = sorted({c for b in self.beginnings for c in b})
        self.letters = np.array([ord(c) for c in letters], np.uint32)
        number = {c: k for k, c in enumerate(letters)}
        nodes = {"": 0} | {b: k for k, b in enumerate(sorted(self.beginnings, key=len), 1)}
        edges = [(nodes[b[:-1]] * len(letters) + number[b[-1]], k) for b, k in nodes.items() if b]
        self.edges, self.leads = (np.array(x, np.int64) for x in zip(*sorted(edges))) if edges else (np.zeros(0, np.int64),) * 2
        self.node_score, self.node_piece = np.full(len(nodes), -np.inf), np.full(len(nodes), -1, np.int32)
        for piece, (score, k) in self.vocabulary.items():
            self.node_score[nodes[piece]], self.node_piece[nodes[piece]] = score, k
        self.single = np.array([c in self.vocabulary for c in letters], bool)

    def __getstate__(self):
        return self.__dict__ | {"memo": {}, "odd": set()}

    @classmethod
    def load(cls, model_path: str) -> Pieces:
        m = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = range(m.get_piece_size())
        byte_ids = [-1] * 256
        for k in n:
            if m.is_byte(k):
                byte_ids[int(m.id_to_piece(k)[1:-1], 16)] = k
        hidden = {k for k in n if m.is_control(k) or m.is_unknown(k) or m.is_unused(k)}
        return cls([m.id_to_piece(k) for k in n], [m.get_score(k) for k in n], byte_ids, hidden, m.unk_id())

    def search(self, text: str) -> Iterator[list[int]]:
        """Ids of a text, in the parts in which they are committed."""
        get, longest, n, low, fallback = self.beginnings.get, self.longest, len(text), -float("inf"), self.fallback
        base, check = 0, 4 * longest
        room = min(n, check + longest) + 1
        best, width, piece = [low] * room, [1] * room, [-1] * room  # of the boundaries from base on
        best[0] = 0.0
        for start in range(n):
            at = start - base
            own = best[at]
            for end in range(start + 1, n + 1):
                found = get(text[start:end], low)
                if found is None:  # a piece's beginning, but no piece
                    continue
                if found is low:
                    break
                score, to = own + found[0], end - base
                if score > best[to]:
                    best[to], width[to], piece[to] = score, end - start, found[1]
            if own + fallback > best[at + 1] and text[start] not in self.vocabulary:
                best[at + 1], width[at + 1], piece[at + 1] = own + fallback, 1, -1
            if at + 1 >= check and start + 1 < n:
                shared = self._shared(best, width, at + 1)
                if shared:
                    yield self._path(text, base, width, piece, shared)
                    del best[:shared], width[:shared], piece[:shared]
                    base += shared
                check = max(4 * longest, 2 * (start + 1 - base))
                more = min(n - base, check + longest) + 1 - len(best)
                if more > 0:
                    best += [low] * more
                    width += [1] * more
                    piece += [-1] * more
        yield self._path(text, base, width, piece, n - base)

    def search_all(self, parts: list[str]) -> list[bytes | None]:
        """Ids of many short texts, 4 bytes each; None where a character is no piece by itself."""
        out: list[bytes | None] = [None] * len(parts)
        if not len(self.letters):
            return out
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = np.minimum(np.searchsorted(self.letters, codes), len(self.letters) - 1)
        known = (self.letters[letter] == codes) & self.single[letter]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        starts = np.cumsum(sizes) - sizes
        for n in np.unique(sizes[sizes > 0]):
            own = np.flatnonzero(sizes == n)
            places = starts[own] + np.arange(n)[:, None]
            fine = known[places].all(0)
            own, places = own[fine], places[:, fine]
            if len(own):
                flat, ends = self._side_by_side(letter[places])
                for k, low, high in zip(own.tolist(), [0, *ends], ends):
                    out[k] = flat[4 * low : 4 * high]
        return out

    def _side_by_side(self, letter: np.ndarray) -> tuple[bytes, list[int]]:
        """The search over texts of one length, a column each: their ids one after another, and where each ends."""
        n, width_of = letter.shape
        best = np.full((n + 1, width_of), -np.inf)
        best[0] = 0.0
        width, piece = np.zeros((n + 1, width_of), np.int16), np.full((n + 1, width_of), -1, np.int32)
        for start in range(n):
            live, node = np.arange(width_of), np.zeros(width_of, np.int64)
            for end in range(start + 1, min(start + self.longest, n) + 1):
                key = node * len(self.letters) + letter[end - 1, live]
                at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
                there = self.edges[at] == key
                live, node = live[there], self.leads[at[there]]
                if not len(live):
                    break
                score = best[start, live] + self.node_score[node]
                better = score > best[end, live]
                won = live[better]
                best[end, won], width[end, won], piece[end, won] = score[better], end - start, self.node_piece[node[better]]
        place, found, columns = np.full(width_of, n), [], np.arange(width_of)
        while len(columns):
            found.append((columns, piece[place, columns]))
            place = place - width[place, columns]
            columns, place = columns[place > 0], place[place > 0]
        whose, ids = (np.concatenate(x) for x in zip(*reversed(found)))
        order = np.argsort(whose, kind="stable")
        return ids[order].astype("<i4").tobytes(), np.cumsum(np.bincount(whose, minlength=width_of)).tolist()

    @staticmethod
    def _shared(best: list, width: list, first: int) -> int:
        """The last boundary on every path to the boundaries from ``first`` on that pieces have reached."""
        live = {k for k in range(first, len(best)) if best[k] > -float("inf")}
        while len(live) > 1:
            last = max(live)
            live.discard(last)
            live.add(last - width[last])
        return live.pop()

    def _path(self, text: str, base: int, width: array, piece: array, end: int) -> list[int]:
        out: list[int] = []
        while end:
            if piece[end] >= 0:
                out.append(piece[end])
            else:
                data = text[base + end - 1].encode("utf-8", "replace")
                ids = [self.byte_ids[b] for b in data]
                out.extend(reversed(ids) if min(ids) >= 0 else [self.unknown])
            end -= width[end]
        return out[::-1]

    def _cut(self, part: str) -> bytes:
        found = list(self.search(part))
        ids = found[0] if len(found) == 1 else list(chain.from_iterable(found))
        if self.decoded(ids) != part:
            self.odd.add(part)
        data = array("i", ids).tobytes()
        if len(part) <= CUT:
            if len(self.memo) >= REMEMBERED:
                self.memo.clear()
                self.odd.clear()
            self.memo[part] = data
        return data

    def learn(self, texts: list[list[str]]) -> None:
        """Remember the ids of the short cuts of some texts."""
        new = [p for p in set(chain.from_iterable(texts)) if len(p) <= CUT and p not in self.memo]
        if len(self.memo) + len(new) > REMEMBERED:
            self.memo.clear()
            self.odd.clear()
            new = [p for p in set(chain.from_iterable(texts)) if len(p) <= CUT]
        self.memo.update((p, ids) for p, ids in zip(new, self.search_all(new), strict=True) if ids is not None)

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[tuple[bytes, bool]]:
        """The ids of whole texts, 4 bytes each, and whether decoding them gives the text.

        Decoding joins what ids stand for, so it does if it does for each cut.
        """

        def done(held: list[list[str]]) -> Iterator[tuple[bytes, bool]]:
            self.learn(held)
            get, cut = self.memo.get, self._cut
            for parts in held:
                ids = b"".join([get(part) or cut(part) for part in parts])
                yield ids, not self.odd or self.odd.isdisjoint(parts)

        held, size = [], 0
        for text in texts:
            held.append(self.cuts.findall(" " + text) if text else [])
            size += len(text or "")
            if size > HELD:
                yield from done(held)
                held, size = [], 0
        yield from done(held)

    def encode(self, text: str | None) -> tuple[bytes, bool]:
        return next(self.encode_all([text]))

    def decoded(self, ids: Iterable[int]) -> str:
        """What ids stand for, with the space that encoding put before the text."""
        return b"".join(map(self.data.__getitem__, ids)).decode("utf-8", "replace")

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids."""
        return self.decoded(ids)[1:]


def encoded(model_path: str) -> Column:
    """ids of column text and whether decoding them gives the text."""
    pieces = Pieces.load(model_path)

    @F.arrow_udf(RESULT)
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts, same = [], []
            for ids, whole in pieces.encode_all(texts.to_pylist()):
                parts.append(ids)
                same.append(whole)
            ends = np.concatenate(([0], np.cumsum([len(p) // 4 for p in parts], dtype=np.int64))).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(parts), np.int32))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            yield pa.StructArray.from_arrays([lists, pa.array(same, pa.bool_())], ["ids", "round_trip"])

    return encode(F.col("text").cast("string"))


def tokenised(docs: DataFrame, model_path: str) -> DataFrame:
    """``docs`` with ids, n_ids and round_trip instead of text."""
    out = packed(docs, "text").withColumn("_e", encoded(model_path))
    rest = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("text", "ids", "n_ids", "round_trip")]
    return out.select(*rest, F.size("_e.ids").cast("long").alias("n_ids"), F.col("_e.ids").alias("ids"), F.col("_e.round_trip").alias("round_trip"))
