"""Text functions as Spark columns: one definition each of words, sentences, syllables.

Null texts count as empty. Python's notion of a word character is Unicode's, hence
``(?U)`` in patterns.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default word lists of the metrics.
QUESTION_WORDS = ("what", "how", "why", "when", "where", "who")
TECHNICAL_WORDS = ("algorithm", "function", "method", "class", "variable")
MEDICAL_WORDS = ("patient", "diagnosis", "treatment", "symptom", "disease")
DENSITY_TERMS = ("diagnosis", "treatment", "patient", "clinical", "medical", "algorithm", "system", "process", "method", "analysis", "research", "study", "data", "model", "framework")
CONNECTORS = ("however", "therefore", "thus", "because", "although", "since", "while")
CONTRADICTIONS = ("but", "however", "although", "despite", "yet")
OPPOSITES = (("always", "never"), ("all", "none"), ("every", "no"))
HARD_WORDS = ("complex", "advanced", "difficult", "challenging")


def text(c: Column) -> Column:
    """The text, empty if null."""
    return F.coalesce(c.cast("string"), F.lit(""))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, wherever ``f`` uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), f), 1)


def words(c: Column) -> Column:
    """Parts between white space."""
    return F.regexp_extract_all(text(c), F.lit(r"\S+"), F.lit(0))


def tokens(c: Column) -> Column:
    """Lower-case words."""
    return words(F.lower(text(c)))


def sentence_count(c: Column) -> Column:
    """Parts between runs of ``.!?`` that are not blank."""
    return F.regexp_count(text(c), F.lit(r"[^.!?\s][^.!?]*"))


def word_count(c: Column) -> Column:
    """How many words, without making them."""
    return F.regexp_count(text(c), F.lit(r"\S+"))


def syllable_count(c: Column) -> Column:
    """Vowel groups of all lower-case words, one less for a word's final e, at least one a word; none without word characters."""

    def counted(t: Column) -> Column:
        count = lambda pattern: F.regexp_count(t, F.lit(pattern))
        without = count(r"\S+") - count(r"[aeiouy]\S*+")
        return count("[aeiouy]+") + without - count(r"[aeiouy][^aeiouy\s]\S*+(?<=e)")

    return bound(F.regexp_replace(F.lower(text(c)), r"(?U)[^\w \t\n\x0B\f\r]+", ""), counted)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def flesch(c: Column, syllables: Column | None = None) -> Column:
    """Flesch reading ease from 0 to 100; 50 without words or sentences. Syllables that are known already can be given."""
    y = syllable_count(c) if syllables is None else syllables

    def ease(x: Column) -> Column:
        score = F.lit(206.835) - F.lit(1.015) * (x["n"] / x["s"]) - F.lit(84.6) * (x["y"] / x["n"])
        return F.when((x["n"] == 0) | (x["s"] == 0), 50.0).otherwise(clamp(score, 0.0, 100.0))

    return bound(F.struct(word_count(c).alias("n"), sentence_count(c).alias("s"), y.alias("y")), ease)


def complexity(c: Column) -> Column:
    """Word length, share of distinct words and sentence length as 0 to 1; null without words."""

    def measured(x: Column) -> Column:
        n = F.size(x["w"])
        length, distinct = F.length(F.array_join(x["w"], "")) / n, F.size(F.array_distinct(x["w"])) / n
        per_sentence = n / F.greatest(F.lit(1), x["s"])
        score = (length - 4) / F.lit(6.0) * F.lit(0.4) + distinct * F.lit(0.3) + (per_sentence - 10) / F.lit(20.0) * F.lit(0.3)
        return F.when(n > 0, clamp(score, 0.0, 1.0))

    return bound(F.struct(words(c).alias("w"), sentence_count(c).alias("s")), measured)


def contains_any(c: Column, names: Sequence[str]) -> Column:
    """How many of the names a lower-case text has as parts."""
    out = F.lit(0)
    for name in names:
        out = out + F.contains(c, F.lit(name)).cast("int")
    return out


def coherence(c: Column, connectors: Sequence[str] = CONNECTORS, contradictions: Sequence[str] = CONTRADICTIONS) -> Column:
    """Connected sentences less contradictions, 0 to 1; 1 for a single sentence."""
    s = F.filter(F.split(F.lower(text(c)), r"\."), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")) != "")
    linked = F.aggregate(s, F.lit(0), lambda a, x: a + contains_any(x, connectors))
    against = F.aggregate(s, F.lit(0), lambda a, x: a + contains_any(x, contradictions))
    base = F.least(F.lit(1.0), linked / (F.size(s) - 1) * F.lit(0.5) + F.lit(0.5))
    return F.when(F.size(s) <= 1, 1.0).otherwise(clamp(base * (F.lit(1.0) - F.least(against * F.lit(0.1), F.lit(0.5))), 0.0, 1.0))


def contradiction_count(c: Column) -> Column:
    """Opposites within a text, by parts of words."""
    t = F.lower(text(c))
    has = lambda x: F.contains(t, F.lit(x))
    out = ((has("yes") & has("no") & has("but")) | has("however")).cast("int")
    for a, b in OPPOSITES:
        out = out + (has(a) & has(b)).cast("int")
    return out


def top_frequency(w: Column) -> Column:
    """How often the most frequent element of an array occurs: the longest run once sorted."""
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("top"))

    def step(a: Column, x: Column) -> Column:
        run = F.when(a["last"] == x, a["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(a["top"], run).alias("top"))

    return F.aggregate(F.sort_array(w), start, step)["top"]


def information_density(c: Column, terms: Sequence[str] = DENSITY_TERMS) -> Column:
    """Length, distinct words, concentration and terms as one score; 0 for blank texts."""
    known = F.regexp_count(F.lower(text(c)), F.lit(rf"(?<!\S)(?:{'|'.join(map(re.escape, terms))})(?!\S)"))

    def measured(x: Column) -> Column:
        n = F.size(x["w"])
        score = (
            F.least(F.lit(1.0), x["length"] / 1000) * F.lit(0.3)
            + F.size(F.array_distinct(x["w"])) / n * F.lit(0.3)
            + (F.lit(1.0) - top_frequency(x["w"]) / n) * F.lit(0.2)
            + x["known"] / n * F.lit(0.2)
        )
        return F.when(n > 0, score).otherwise(0.0)

    return bound(F.struct(words(c).alias("w"), F.length(text(c)).alias("length"), known.alias("known")), measured)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two arrays; 1 if both are empty, 0 if one is."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - both
    return F.when(every == 0, 1.0).otherwise(both / every)


def like_escaped(term: str) -> str:
    """A search term with the wildcards of LIKE taken literally."""
    return term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def semver(c: Column) -> Column:
    """major, minor and patch of a version text; null if it is none."""
    p = F.split(c, r"\.")
    part = lambda k: F.element_at(p, k).cast("int")
    return F.when(c.rlike(r"^\d+\.\d+\.\d+$"), F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch")))


def entropy(share: Column) -> Column:
    """Base-2 entropy of the shares in a group, as an aggregate."""
    return -F.sum(F.when(share > 0, share * F.log2(share)).otherwise(0.0))


def normalise_markdown(c: Column) -> Column:
    """At most three line ends in a row, no spaces at line ends, single spaces outside tables."""
    t = F.regexp_replace(text(c), r"\n{4,}", "\n\n\n")
    lines = F.transform(F.split(t, "\n"), lambda x: F.when(F.contains(x, F.lit("|")), F.rtrim(x)).otherwise(F.rtrim(F.regexp_replace(x, " {2,}", " "))))
    return F.array_join(lines, "\n")


def strip_image_tags(c: Column) -> Column:
    return F.regexp_replace(text(c), r"\[Image:.*?\]", "")
