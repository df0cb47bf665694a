"""Spelling variants by a symmetric-delete join (operator 11).

Words are maximal runs of Latin letters, counted with Spark's partial aggregation. Every
word emits itself and its single deletions; rows with equal keys meet in one shuffle.
Two words that leave one key by a deletion at one place differ in that letter alone, and
a word that is another's deletion differs by one inserted letter, so equal keys with
equal places verify the distance of exactly one. A key's rows are numbered and counted by
windows, never paired: a row's best neighbour at its place is the first one or, for the
first itself, the second. A key of k letters has at most 90 (k + 1) + 1 words, as many as
letters can stand in its gaps, whatever the corpus. Keys of over 64 letters travel as
their SHA-256.

A word's form is its most frequent neighbour if that is ``ratio`` times as frequent or
more; roots follow forms by pointer doubling, one written join a round. Counts grow along
forms by ``ratio``, so with 2 there are 6 rounds at most for counts of 64 bits.

``mistyped`` takes, of each word in a document, the code points that the document and the
word's checksum name: known misspellings in real counts.

Null and empty texts have no words; a null id is the empty text in checksums; repeated
rows count once each; ties in counts go to the smaller word in code-point order; other
columns, whatever their names, are not looked at. An empty table has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

RUN = "[A-Za-zÀ-ÿ]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LONG = 64  # letters of a key above which its digest stands for it


def lowered(word: Column) -> Column:
    """A-Z in lower case; plain words take the short way."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, CAPITALS, SMALL))


def without(word: Column, k: Column) -> Column:
    """The word less its code point at ``k``, from 0."""
    return F.concat(F.substring(word, F.lit(1), k), F.substring(word, k + 2, F.length(word)))


def mistyped(word: Column, doc_id: Column, every: int) -> Column:
    """The word less one code point where ``every`` divides the unsigned crc32 of ``<doc_id>:<word>``."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    return F.when(h % every == 0, without(word, (h % F.length(word)).cast("int"))).otherwise(word)


def word_counts(docs: DataFrame, every: int = 0, shortest: int = 5, least: int = 3) -> DataFrame:
    """word and n of the words of whole texts; with ``every``, after taking letters from some."""
    runs = docs.select(F.col("doc_id"), F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(RUN), F.lit(0))).alias("run"))
    words = runs.select("doc_id", lowered(F.col("run")).alias("word"))
    words = words.select(mistyped(F.col("word"), F.col("doc_id"), every).alias("word")) if every else words.select("word")
    return words.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def numbered(words: DataFrame) -> DataFrame:
    """word and n with ids that ascend as the words do, written."""
    return written(written(words.select("word", "n")).orderBy("word").withColumn("id", F.monotonically_increasing_id()))


def neighbours(words: DataFrame) -> DataFrame:
    """id, n_near and the best neighbour (its count negated, its id) of the words that have any."""
    letter = lambda k: F.substring("word", k, F.lit(1))
    at = F.explode(F.sequence(F.lit(0), F.length("word"))).alias("at")  # 0: the word itself
    rows = words.select("word", "id", (-F.col("n")).alias("m"), at)
    key = F.when(F.col("at") == 0, F.col("word")).otherwise(without(F.col("word"), F.col("at") - 1))
    distinct = (F.col("at") == 1) | ((F.col("at") > 1) & (letter(F.col("at")) != letter(F.col("at") - 1)))  # of a letter's run the first
    rows = rows.select("id", "m", "at", F.when(F.length(key) > LONG, F.concat(F.lit("#"), F.sha2(key, 256))).otherwise(key).alias("key"), distinct.alias("distinct"))
    me = F.struct("m", "id")
    whole, place = Window.partitionBy("key"), Window.partitionBy("key", "at")
    order = place.orderBy("m", "id")
    met = rows.select(
        "*",
        F.min(F.when(F.col("at") == 0, me)).over(whole).alias("shorter"),
        F.count(F.when(F.col("distinct"), 1)).over(whole).alias("n_longer"),
        F.min(F.when(F.col("distinct"), me)).over(whole).alias("longer"),
    )
    met = met.select(
        "*",
        (F.count("*").over(place) - 1).alias("n_place"),
        F.when(F.row_number().over(order) == 1, F.lead(me).over(order)).otherwise(F.first(me).over(order)).alias("other"),
    )
    own = F.col("distinct") & F.col("shorter").isNotNull()
    n = F.when(F.col("at") == 0, F.col("n_longer")).otherwise(F.col("n_place") + own.cast("long"))
    best = F.when(F.col("at") == 0, F.col("longer")).otherwise(F.least("other", F.when(own, F.col("shorter"))))
    return met.select("id", n.alias("near"), best.alias("best")).where("near > 0").groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """id and root of ids with a form: links (id, form) doubled until none moves."""
    links = forms.select("id", F.col("form").alias("root"))
    while True:
        ahead = links.select(F.col("id").alias("root"), F.col("root").alias("next"))
        moved = written(links.join(ahead, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        links = moved.select("id", "root")
        if not moved.agg(F.max("moved")).first()[0]:
            return links


def grouped(words: DataFrame, ratio: int = 2) -> DataFrame:
    """word, n, n_near, form, form_n and root of every row of (word, n), whose words differ."""
    words = numbered(words)
    best = F.when(-F.col("best.m") >= ratio * F.col("n"), F.col("best"))
    linked = written(words.join(neighbours(words), "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), best["id"].alias("form"), (-best["m"]).alias("form_n")))
    ends = roots(linked.where(F.col("form").isNotNull()))
    named = lambda c: words.select(F.col("id").alias(c), F.col("word").alias(f"{c}_word"))
    out = linked.join(ends, "id", "left").join(named("form"), "form", "left").join(named("root"), "root", "left")
    return out.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
