"""Operator 11 against plain comparison of all words, and on nulls, empties, ties, repeats and long words."""

import collections
import random
import re
import zlib

import duckdb
from pyspark.sql import functions as F

from sparkloom.llm import registry, variants

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans(variants.CAPITALS, variants.SMALL)


def near(a, b):
    """Exactly one inserted, deleted or replaced letter, told from common ends."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k:] == b[k + 1 :] if len(a) < len(b) else a[k + 1 :] == b[k + 1 :]


def plain(count, ratio=2):
    out = {}
    for w, n in count.items():
        close = [v for v in count if near(w, v)]
        best = min(close, key=lambda v: (-count[v], v), default=None)
        form = best if best and count[best] >= ratio * n else None
        out[w] = (w, form, n, len(close), count[form] if form else None)

    def root(w):
        return root(out[w][1]) if out[w][1] else w

    return sorted((w, form or "", root(w), n, m, fn or 0) for w, form, n, m, fn in out.values())


def listed(found):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in found.collect())


def test_against_all_pairs(spark):
    """Repeated letters, accents, shifts by one letter, chains of forms, ties; words of over 64 letters."""
    rng = random.Random(1)
    words = {"".join(rng.choices("aaabé", k=rng.randint(4, 7))) for _ in range(250)}
    words |= {w[1:] + w[0] for w in list(words)[:60]}
    long = "".join(rng.choices("abc", k=70))
    words |= {long, long[:65], long[:64], long[:30] + "z" + long[30:], long[:10] + "z" + long[11:], "z" + long[:64]}
    count = {w: rng.choice([1, 2, 3, 6, 6, 12, 40, 200]) for w in sorted(words)}
    df = spark.createDataFrame(list(count.items()), "word string, n long").withColumns({c: F.lit(1) for c in ("id", "key", "at", "m")})
    assert listed(variants.grouped(df)) == plain(count)


def test_chain_of_forms(spark):
    """Each form twice as frequent: the last is the root of all."""
    words = ["a" * k + "bcdef" for k in range(40)]
    found = variants.grouped(spark.createDataFrame([(w, 2**k) for k, w in enumerate(words)], "word string, n long"))
    assert {r.root for r in found.collect()} == {words[-1]}


def test_hot_key_is_not_paired(spark):
    """Words that share all but one letter: as many rows as words and places, not as pairs."""
    letters = [chr(c) for c in range(0xE0, 0x100)]
    count = {f"wort{x}teil": k + 1 for k, x in enumerate(letters)}
    assert listed(variants.grouped(spark.createDataFrame(list(count.items()), "word string, n long"))) == plain(count)


def test_words_and_missing_letters(spark):
    rng = random.Random(2)
    pool = ["Straße", "élève", "École", "naïve", "words", "wordy", "letter", "Ünder", "×÷ABC"]
    texts = [" ".join(rng.choices(pool, k=300)) + rng.choice([".", "1", "_", "日本"]) for _ in range(30)]
    rows = [(k, t, 1) for k, t in enumerate(texts)] + [(None, "words words", 1), (5, None, 1), (6, "", 1), (7, "1 2 _", 1), (8, "x" * 5000 + " " + "x" * 5000 + " " + "X" * 5000, 1)]
    count = collections.Counter()
    for doc_id, text, _ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            count[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 7 == 0 else w] += 1
    want = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    got = variants.word_counts(spark.createDataFrame(rows, "doc_id long, text string, word int"), every=7)
    assert {r.word: r.n for r in got.collect()} == want


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert variants.grouped(variants.word_counts(docs, every=97)).count() == 0
    assert variants.grouped(variants.word_counts(spark.createDataFrame([(1, None), (None, "ab")], "doc_id long, text string"))).count() == 0


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    found = con.execute(registry.ORACLE_SQL["op11_variants"])
    columns = [c[0] for c in found.description]
    got = registry.QUERIES["op11_variants"](spark, SF)
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, found.fetchall()))
