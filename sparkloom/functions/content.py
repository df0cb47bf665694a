"""Samples of long texts for a model to look at: lines around patterns, or headings with the begin, middle and end."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text

WHOLE = 10_000  # characters up to which a text is its own sample
SLICE = 5000
SECTIONS, HEADERS, LOOKED_AT = 5, 10, 100


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def capitals(c: Column) -> Column:
    """Whether a line has letters, all of them capitals."""
    return (F.upper(c) == c) & (F.lower(c) != c)


def patterns(examples: Sequence[str]) -> list[str]:
    """Lines of a user's examples that look like headings or lists of authors: capitals only, or with ``@`` or a comma."""
    lines = [line.strip() for e in examples for line in e.split("\n")]
    return [line for line in lines if line and (line.isupper() or "@" in line or "," in line)]


def intervals(hits: Column, n: Column, context: int) -> Column:
    """Line numbers from 0 widened by ``context`` on both sides and merged where they touch or overlap: structs of first and last."""
    wide = F.transform(hits, lambda k: F.struct(F.greatest(k - context, F.lit(0)).alias("first"), F.least(k + context, n - 1).alias("last")))
    none = F.array().cast("array<struct<first:int,last:int>>")

    def join(acc: Column, x: Column) -> Column:
        end = F.try_element_at(acc, F.lit(-1))
        longer = F.struct(end["first"].alias("first"), F.greatest(end["last"], x["last"]).alias("last"))
        return F.when((F.size(acc) > 0) & (x["first"] <= end["last"] + 1), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(longer))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(wide, none, join)


def contexts(c: Column, wanted: Sequence[str], context: int = 2, merged: bool = False) -> Column:
    """Sections of lines around those that have a wanted pattern, in any case, or only capitals; each once, in order.

    Without ``merged`` each line that matches has a section of its own.
    """
    lines = F.split(text(c), "\n")
    stripped = F.transform(lines, _stripped)
    found = lambda line: reduce(lambda a, b: a | b, [F.contains(F.lower(line), F.lit(p.lower())) for p in wanted], capitals(line))
    marked = F.transform(stripped, lambda line, k: F.when(found(line), k))
    hits = F.filter(marked, lambda k: k.isNotNull()) if wanted else F.array().cast("array<int>")
    if merged:
        return F.transform(intervals(hits, F.size(lines), context), lambda x: F.array_join(F.slice(lines, x["first"] + 1, x["last"] - x["first"] + 1), "\n"))
    start = lambda k: F.greatest(k - context, F.lit(0))
    return F.array_distinct(F.transform(hits, lambda k: F.array_join(F.slice(lines, start(k) + 1, k + context + 1 - start(k)), "\n")))


def headings(c: Column) -> Column:
    """Of the first lines those that start with ``#``, or with a capital and are short; at most ten."""
    lines = F.transform(F.slice(F.split(text(c), "\n"), 1, LOOKED_AT), _stripped)
    capital = lambda x: capitals(F.substring(x, 1, 1))
    return F.slice(F.filter(lines, lambda x: x.startswith("#") | ((F.length(x) < 100) & capital(x))), 1, HEADERS)


def sample(c: Column, examples: Sequence[str] = ()) -> Column:
    """A short text whole; else its sections around a user's examples; else headings, begin, middle and end."""
    t = text(c)
    n = F.length(t)
    size = F.least(F.lit(SLICE), F.floor(n / 3)).cast("int")
    half = (F.floor(n / 2) - F.floor(size / 2) + 1).cast("int")
    # What stands around the parts.
    parted = F.concat(
        F.lit("=== KEY HEADERS/TITLES ===\n"), F.array_join(headings(c), "\n"), F.lit("\n\n=== BEGINNING SECTION ===\n"), F.substring(t, F.lit(1), size),
        F.lit("\n\n=== MIDDLE SECTION ===\n"), F.substring(t, half, size), F.lit("\n\n=== END SECTION ===\n"), F.right(t, size),
    )
    wanted = patterns(examples)
    if wanted:
        own = contexts(c, wanted)
        parted = F.when(F.size(own) > 0, F.concat(F.lit("=== RELEVANT SECTIONS MATCHING USER EXAMPLES ===\n"), F.array_join(F.slice(own, 1, SECTIONS), "\n"))).otherwise(parted)
    return F.when(n <= WHOLE, t).otherwise(parted)
