"""Chunkers: one row per text to one row per chunk.

A strategy is a small validated description that compiles to an array column, so
that chunking is a projection and never shuffles. Only for chunks that span a document's
files (``cross_file``) lengths or last chunks of files meet in order, never whole texts.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import kept

MAX_BYTES = 10 * 1024 * 1024
PREVIEW = 200
END = "\x01"  # stands where a text is cut


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _kept(parts: Column) -> Column:
    return F.filter(F.transform(parts, _strip), lambda p: p != "")


def windows(n: Column, size: int, overlap: int) -> Column:
    """Starts of windows of ``size`` over ``n`` items."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))


def _sizes(size: int, overlap: int) -> None:
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError(f"need size > 0 and 0 <= overlap < size, not {size} and {overlap}")


@dataclass(frozen=True)
class Character:
    """Windows of characters, not trimmed; none for blank texts."""

    size: int = 1000
    overlap: int = 0

    def __post_init__(self):
        _sizes(self.size, self.overlap)

    def column(self, c: Column) -> Column:
        t = X.text(c)
        n = F.when(_strip(t) == "", 0).otherwise(F.length(t))
        return F.transform(windows(n, self.size, self.overlap), lambda s: F.substring(t, s + 1, F.lit(self.size)))

    def unfinished(self, last: Column) -> Column:
        return F.length(last) < F.lit(0.8) * self.size


@dataclass(frozen=True)
class Token:
    """Windows of words between white space."""

    size: int = 512
    overlap: int = 0

    def __post_init__(self):
        _sizes(self.size, self.overlap)

    def column(self, c: Column) -> Column:
        return X.bound(X.words(c), lambda w: F.transform(windows(F.size(w), self.size, self.overlap), lambda s: F.array_join(F.slice(w, s + 1, F.lit(self.size)), " ")))

    def unfinished(self, last: Column) -> Column:
        return F.size(X.words(last)) < F.lit(0.8) * self.size


@dataclass(frozen=True)
class Bpe:
    """Windows of tokens of a byte-level vocabulary: a file of ranks and the pattern that splits texts.

    Each window is decoded by itself, so that one which ends inside a character has a
    replacement there, as usual for token chunks. None for blank texts.
    """

    ranks: str
    pattern: str
    size: int = 512
    overlap: int = 0

    def __post_init__(self):
        _sizes(self.size, self.overlap)

    def column(self, c: Column) -> Column:
        self._content  # noqa: B018  read here, not in the tasks
        return F.pandas_udf(self._cut, "array<string>")(X.text(c))

    def _encoding(self):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self._content.splitlines())}
        return tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def _content(self) -> bytes:
        """The vocabulary as read on the driver; it goes to the tasks with the function."""
        with open(self.ranks, "rb") as f:
            return f.read()

    def _cut(self, batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = self._encoding()
        for texts in batches:
            out = []
            for t in texts:
                ids = encoding.encode_ordinary(t) if t.strip() else []
                out.append([encoding.decode(ids[k : k + self.size]) for k in range(0, len(ids), self.size - self.overlap)])
            yield pd.Series(out, dtype=object)

    def unfinished(self, last: Column) -> Column:
        size = F.pandas_udf(self._count, "int")(last)
        return size < F.lit(0.8) * self.size

    def _count(self, batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = self._encoding()
        for texts in batches:
            yield pd.Series([len(encoding.encode_ordinary(t or "")) for t in texts], dtype="int32")


@dataclass(frozen=True)
class Delimiter:
    """Parts between literal delimiters, trimmed, blanks dropped."""

    delimiter: str = "\n\n"

    def __post_init__(self):
        if not self.delimiter:
            raise ValueError("need a delimiter")

    def column(self, c: Column) -> Column:
        return _kept(F.split(X.text(c), rf"\Q{self.delimiter}\E"))

    def unfinished(self, last: Column) -> Column:
        return ~last.endswith(self.delimiter)


@dataclass(frozen=True)
class Rule:
    """Where to cut: after a ``pattern`` match (before it with ``include``), after a ``delimiter``, after a ``heading`` line."""

    kind: str
    value: str = ""
    include: bool = False

    def __post_init__(self):
        if self.kind not in ("pattern", "delimiter", "heading"):
            raise ValueError(f"unknown rule {self.kind}")

    @property
    def pattern(self) -> str:
        return {"pattern": self.value, "delimiter": re.escape(self.value), "heading": r"^#+[^\n]*(?:\n|\Z)"}[self.kind]

    def cuts(self, t: str) -> set[int]:
        """Cut positions of a text, for rules that must all agree."""
        return {m.start() if self.include else m.end() for m in re.finditer(self.pattern, t, re.M)}


@dataclass(frozen=True)
class Schema:
    """Cuts where any rule, or all rules, say so; the whole text if nowhere."""

    rules: tuple[Rule, ...] = field(default_factory=tuple)
    combine: str = "any"

    def __post_init__(self):
        if not self.rules or self.combine not in ("any", "all"):
            raise ValueError("need rules, and combine any or all")

    def column(self, c: Column) -> Column:
        t = X.text(c)
        if self.combine == "all" and len(self.rules) > 1:
            return _kept(F.pandas_udf(self._all, "array<string>")(t))
        for r in self.rules:
            t = F.regexp_replace(t, f"(?m)({r.pattern})", f"{END}$1" if r.include else f"$1{END}")
        return _kept(F.split(t, END))

    def _all(self, texts: pd.Series) -> pd.Series:
        def cut(t: str) -> list[str]:
            at = sorted(set.intersection(*(r.cuts(t) for r in self.rules)) - {0, len(t)})
            return [t[a:b] for a, b in zip([0, *at], [*at, len(t)], strict=True)]

        return texts.map(cut)

    def unfinished(self, last: Column) -> Column:
        """Starts with a pattern that occurs once: the section may go on in the next file."""
        out = F.lit(False)
        for r in self.rules:
            if r.kind == "pattern":
                out = out | (last.rlike(f"^(?:{r.pattern})") & (F.regexp_count(last, F.lit(f"(?m){r.pattern}")) <= 1))
        return out


@dataclass(frozen=True)
class Headings:
    """Cuts before headings that a model proposed, given as an array column."""

    headings: str

    def column(self, c: Column) -> Column:
        marked = F.aggregate(F.col(self.headings), X.text(c), lambda a, h: F.when(h == "", a).otherwise(F.replace(a, h, F.concat(F.lit(END), h))))
        return _kept(F.split(marked, END))

    def unfinished(self, last: Column) -> Column:
        return (F.length(last) < 200) | ~last.rlike(r'[.!?"]\s*$')


Strategy = Character | Token | Bpe | Delimiter | Schema | Headings


def chunk(docs: DataFrame, strategy: Strategy, content: str = "text", max_bytes: int | None = MAX_BYTES) -> DataFrame:
    """``docs`` without their text, with chunk_index (from 1) and chunk.

    Texts of more than ``max_bytes`` bytes are refused, as an error of the row's task.
    """
    c = F.col(content)
    if max_bytes:
        c = F.when(F.octet_length(c) > max_bytes, F.raise_error(F.lit(f"text of more than {max_bytes} bytes"))).otherwise(c)
    rest = [x for x in docs.columns if x != content]
    return docs.select(*rest, F.posexplode(strategy.column(c)).alias("_k", "chunk")).select(*rest, (F.col("_k") + 1).alias("chunk_index"), "chunk")


def preview(chunks: DataFrame) -> DataFrame:
    """Chunk rows as they are stored: index, length and the first 200 characters."""
    return chunks.withColumns({"chunk_len": F.length("chunk"), "preview": F.substring("chunk", 1, PREVIEW)}).drop("chunk")


def sliding(files: DataFrame, strategy: Strategy, marker: str = "[OVERLAP]") -> DataFrame:
    """document_id, chunk and first_file over ordered files with the tail of the file before.

    The first occurrence of a chunk counts; chunks that start with the marker go.
    """
    content = F.concat(F.when(F.col("overlap_content").isNotNull(), F.concat(F.lit(f"{marker} "), F.col("overlap_content"), F.lit("\n"))).otherwise(""), X.text(F.col("main_content")))
    found = chunk(files.select("document_id", "file_seq", content.alias("text")), strategy)
    return found.where(~F.col("chunk").startswith(marker)).groupBy("document_id", "chunk").agg(F.min("file_seq").alias("first_file"))


WHITE = " \t\n"  # what parts two texts without a space between them


def cross_file(files: DataFrame, strategy: Strategy | int = 1000) -> DataFrame:
    """document_id, chunk_index (from 1) and chunk of documents that lie in several files, in the order of file_seq.

    A file's last chunk, if the strategy calls it unfinished, goes in front of the next
    file's text (behind a space if neither side has white space there); the last file's
    stays. Documents and files are chunked in parallel, one huge document too: windows of
    characters or words follow from lengths alone, which are all that is read in order;
    for the others files are chunked as if nothing came before, and those to which
    something does again, until nothing changes.
    """
    strategy = Character(strategy) if isinstance(strategy, int) else strategy
    rows = files.select("document_id", "file_seq", X.text(F.col("main_content")).alias("t"))
    return _by_length(rows, strategy) if isinstance(strategy, (Character, Token)) else _by_rounds(rows, strategy)


def _carried(batches: Iterator[pd.DataFrame], size: int, step: int, spaced: bool) -> Iterator[pd.DataFrame]:
    """Per file: what comes in (units), whether a space does, the index of its first chunk, its windows, and whether the last is carried on.

    dropped counts the times that white space carried on met nothing else and went.
    """
    document, carry, white, behind, n, dropped, started = None, 0, True, 0, 0, 0, False
    for b in batches:
        out = []
        for d, units, first, last, blank, tail, final in zip(*(b[c] for c in ("document_id", "units", "first", "last", "blank", "tail", "final")), strict=True):
            if not started or d != document:
                document, carry, white, behind, n, dropped, started = d, 0, True, 0, 0, 0, True
            gap = int(spaced and carry > 0 and units > 0 and not white and not first)
            own = carry + gap + units
            if spaced and blank and carry <= behind:  # nothing but white space
                own, dropped = 0, dropped + (carry > 0)
            windows = -(-own // step) if own else 0
            rest = own - (windows - 1) * step if windows else 0
            on = bool(windows and rest < 0.8 * size and not final)
            out.append((carry, gap, n, windows, on, dropped))
            n += windows - on
            if units:
                white, behind = last, behind + gap + units if blank else tail
            carry = rest if on else 0
        yield pd.concat([b[["document_id", "file_seq"]], pd.DataFrame(out, columns=["carry", "gap", "base", "windows", "on", "dropped"])], axis=1)


def _by_length(rows: DataFrame, strategy: Character | Token) -> DataFrame:
    words = isinstance(strategy, Token)
    size, step = strategy.size, strategy.size - strategy.overlap
    t = F.col("t")
    units = X.word_count(t) if words else F.length(t)
    starts = F.length(t) - F.length(F.regexp_replace(t, r"(?U)\s+$", ""))
    sizes = rows.select(
        "document_id", "file_seq", units.alias("units"), F.substring(t, 1, 1).isin(*WHITE).alias("first"), F.right(t, F.lit(1)).isin(*WHITE).alias("last"), (_strip(t) == "").alias("blank"), starts.alias("tail"),
    )
    sizes = sizes.repartition("document_id").withColumn("final", F.lead(F.lit(1)).over(Window.partitionBy("document_id").orderBy("file_seq")).isNull())
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("document_id", "file_seq"))
    ordered = sizes.where("document_id IS NOT NULL").sortWithinPartitions("document_id", "file_seq")
    placed = ordered.mapInPandas(lambda b: _carried(b, size, step, not words), f"{kinds}, carry int, gap int, base long, windows int, on boolean, dropped int")
    both = rows.join(placed, ["document_id", "file_seq"]).where("windows > 0")
    # what a file has of each of its windows, from where the window, or the file's own part, begins; its text is cut once for all
    own = X.words(t) if words else F.concat(F.repeat(F.lit(" "), F.col("gap")), t)

    def part(own: Column, k: Column) -> Column:
        at = k * step - F.col("carry")
        low, n = F.greatest(at, F.lit(0)), at + size - F.greatest(at, F.lit(0))
        return F.array_join(F.slice(own, low + 1, F.greatest(n, F.lit(0))), " ") if words else F.substring(own, low + 1, F.greatest(n, F.lit(0)))

    def windows_of(ks: Column) -> DataFrame:
        cut = X.bound(own, lambda o: F.transform(ks, lambda k: F.struct(k.alias("k"), part(o, k).alias("chunk"))))
        each = both.where(F.size(ks) > 0).select("document_id", "file_seq", "base", "dropped", whole.alias("whole"), F.explode(cut).alias("w"))
        return each.select("document_id", (F.col("base") + F.col("w.k") + 1).cast("int").alias("chunk_index"), "dropped", "file_seq", "w.chunk", (F.col("w.k") < F.col("whole")).alias("whole"))

    # windows that begin and end in a file are chunks; only its first behind what was carried, and its last that goes on, meet others
    whole, behind = F.col("windows") - F.col("on").cast("int"), (F.col("carry") > 0).cast("int")
    alone = windows_of(F.when(whole > behind, F.sequence(behind, whole - 1)).otherwise(F.array().cast("array<int>")))
    parts = windows_of(F.array_distinct(F.array_compact(F.array(F.when(F.col("carry") > 0, 0), F.when(F.col("on"), F.col("windows") - 1))))).where("chunk <> '' OR whole")
    joined = F.transform(F.array_sort(F.collect_list(F.when(F.col("chunk") != "", F.struct("file_seq", "chunk")))), lambda x: x["chunk"])
    chunks = parts.groupBy("document_id", "chunk_index", "dropped").agg(F.array_join(joined, " " if words else "").alias("chunk"), F.bool_or("whole").alias("whole")).where("whole")
    return alone.select("document_id", "chunk_index", "chunk").unionByName(chunks.select("document_id", "chunk_index", "chunk"))


def _by_rounds(rows: DataFrame, strategy: Strategy) -> DataFrame:
    keys = ["document_id", "file_seq"]
    order = Window.partitionBy("document_id").orderBy("file_seq")
    # whole texts are dealt and written once; rounds then hold what goes on to the next file, never chunks
    whole = kept(rows.withColumns({"before": F.lag("file_seq").over(order), "final": F.lead("file_seq").over(order).isNull()}))

    def chunked(some: DataFrame) -> DataFrame:
        """``some`` (keys, t, before, final, carry) with its chunks, and what goes on to the next file."""
        white = lambda c: c.isin(*WHITE)
        gap = F.when((F.col("carry") != "") & (F.col("t") != "") & ~white(F.right("carry", F.lit(1))) & ~white(F.substring("t", 1, 1)), " ").otherwise("")
        found = some.withColumn("chunks", strategy.column(F.concat("carry", gap, "t")))
        last = F.coalesce(F.try_element_at("chunks", F.lit(-1)), F.lit(""))
        unfinished = (F.size("chunks") > 0) & ~F.col("final") & strategy.unfinished(last)
        return found.withColumn("on", F.when(unfinished, last).otherwise(""))

    def carried(some: DataFrame) -> DataFrame:
        return chunked(some).select(*keys, "before", "carry", "on", (F.size("chunks") - (F.col("on") != "").cast("int")).alias("n"))

    state = kept(carried(whole.withColumn("carry", F.lit(""))))
    while True:
        ahead = state.where("`on` <> ''").select("document_id", F.col("file_seq").alias("before"), F.col("on").alias("new"))
        changed = state.select(*keys, "before", F.col("carry").alias("old")).join(ahead, ["document_id", "before"], "left")
        changed = kept(changed.withColumn("new", F.coalesce("new", F.lit(""))).where("new <> old").select(*keys, F.col("new").alias("carry")))
        if changed.isEmpty():
            break
        again = carried(whole.join(changed, keys))
        state = kept(state.join(changed.select(*keys), keys, "left_anti").unionByName(again))
    base = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = state.select(*keys, "n").withColumn("base", base).select(*keys, "base")
    placed = state.select(*keys, "carry").join(counted, keys)
    out = chunked(whole.join(placed, keys)).withColumn("done", F.when(F.col("on") == "", F.col("chunks")).otherwise(F.slice("chunks", 1, F.size("chunks") - 1)))
    return out.select("document_id", "base", F.posexplode("done").alias("k", "chunk")).select("document_id", (F.col("base") + F.col("k") + 1).cast("int").alias("chunk_index"), "chunk")


def upper_median(rows: DataFrame, by: str, value: str) -> DataFrame:
    """The element at n // 2 of each group's sorted values, from counts per value."""
    counts = rows.groupBy(by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("v"))
    ordered = counts.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col("_v").cast("long").alias("v"), "_n"))).alias("c"), F.sum("_n").alias("total"))
    at = F.floor(F.col("total") / 2)
    step = lambda a, x: F.struct((a["n"] + x["_n"]).alias("n"), F.when(a["v"].isNull() & (a["n"] + x["_n"] > at), x["v"]).otherwise(a["v"]).alias("v"))
    return ordered.select(by, F.aggregate("c", start, step)["v"].alias(f"upper_median_{value}"))


def distribution(docs: DataFrame, by: str, content: str = "text") -> DataFrame:
    """Count, mean, least, most and upper medians of characters and words per group."""
    rows = docs.select(by, F.length(X.text(F.col(content))).alias("len"), F.size(X.words(F.col(content))).alias("words"))
    out = rows.groupBy(by).agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"), F.min("len").alias("min_len"), F.max("len").alias("max_len"))
    return out.join(upper_median(rows, by, "len"), by).join(upper_median(rows, by, "words"), by)


def page_splits(files: DataFrame, pages: str, per_split: int = 200, overlap: int = 1) -> DataFrame:
    """Page ranges of a file: windows of ``per_split`` pages that share ``overlap`` pages, with links."""
    n, step = F.col(pages), per_split - overlap
    last = F.greatest(F.lit(0), F.ceil((n - per_split) / step)).cast("int")
    rest = [c for c in files.columns if c != pages]
    k = F.col("_k")
    return (
        files.where(n > 0)
        .select(*rest, n.alias("_n"), last.alias("_last"), F.explode(F.sequence(F.lit(0), last)).alias("_k"))
        .select(
            *rest, (k + 1).alias("chunk_number"), (k * step + 1).alias("start_page"), F.least(k * step + per_split, F.col("_n")).alias("end_page"),
            F.when(k > 0, k).alias("prev_chunk"), F.when(k < F.col("_last"), k + 2).alias("next_chunk"),
        )
    )


def headers(c: Column) -> Column:
    """How many lines look like headings: ``#``, capitals only, or more than 80 % capitals."""

    def is_header(line: Column) -> Column:
        s = _strip(line)
        letters = F.regexp_count(s, F.lit(r"\p{L}"))
        capitals = F.regexp_count(s, F.lit(r"\p{Lu}"))
        return s.startswith("#") | ((F.length(s) > 3) & (capitals > 0) & (s == F.upper(s))) | ((letters > 3) & (capitals > F.lit(0.8) * letters))

    return F.size(F.filter(F.split(X.text(c), "\n"), is_header))
