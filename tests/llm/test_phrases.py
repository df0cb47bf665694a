"""Operator 13 against plain counting, and on nulls, empties, ties, repeats and clashing names."""

import collections
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import phrases, registry

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, phrase string, n long, rank int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows):
    """Counts of phrases by language, and words in all, by plain loops."""
    f, total = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            total[lang or "und"] += len(w)
            for k in (1, 2, 3):
                f[lang or "und"].update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    return f, total


def plain(rows, top=2000, least=10):
    f, total = counted(rows)
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if p.count(" ") in (1, 2) and a >= least}
        gone = {q for p, a in found.items() if p.count(" ") == 2 for q in (p.rpartition(" ")[0], p.partition(" ")[2]) if 100 * a >= 50 * found[q]}
        best = []
        for p, a in found.items():
            if p not in gone:
                w = p.split(" ")
                parts = [(c[" ".join(w[:k])], c[" ".join(w[k:])], k) for k in range(1, len(w))]
                s, _, left, right = min((1000000 * a * a // (x * y), k, x, y) for x, y, k in parts)
                best.append((-s, -a, p.encode(), left, right))
        out += [(lang, i, p.decode(), -a, x, y, total[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(1, text, lang, "x", 3, 9) for text, lang in rows], DOCS)


def same(spark, rows, **options):
    options = {"bits": 1 << 12, "shard_bytes": 300} | options
    got = sorted(tuple(r) for r in phrases.collocations(frame(spark, rows), **options).collect())
    assert got == plain(rows, **{k: v for k, v in options.items() if k in ("top", "least")})
    return got


def test_against_plain_counting(spark):
    """Pieces, several spaces, capitals, null languages, ties, an only word a text, shards smaller than a text."""
    rng = random.Random(3)
    words = ["Aa", "b", "é", "É", "ccc", " x", "😀"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", ", ", ".", "\n"]) for _ in range(n))
    rows = [(text(rng.randint(1, 60)), rng.choice(["en", "fr", None, "und"])) for _ in range(120)]
    assert len(same(spark, rows)) > 50


def test_full_filter_loses_nothing(spark):
    """With 64 bits nearly every bit is set: more rows, the same result."""
    rng = random.Random(4)
    rows = [(" ".join(rng.choices([f"w{k}" for k in range(80)], [1 / (k + 1) for k in range(80)], k=300)), "en") for _ in range(30)]
    assert same(spark, rows, bits=64) == same(spark, rows, bits=1 << 20)


def test_edges(spark):
    """Null, empty, blank and break-only texts, repeated rows, one long text, a hot word, fewer than the top."""
    rows = [(None, "en"), ("", None), (" \t ", "en"), ("...", "en"), ("one", "en")] + [("same words here, and HERE", "en")] * 12 + [("a b " * 5000, "de"), ("x " * 30, "fr")]
    assert [r[2] for r in same(spark, rows, top=2) if r[0] == "en"] == ["and here", "same words here"]
    assert phrases.collocations(frame(spark, [])).count() == 0
    assert phrases.collocations(frame(spark, [(None, None)])).count() == 0


def test_score_is_exact(spark):
    """Products beyond 64 bits are not rounded."""
    a, left, right = 3_000_000_019, 3_000_000_021, 3_000_000_037
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long").selectExpr(f"{phrases.SCORE} AS s").first()
    assert row.s == 1000000 * a * a // (left * right)


@pytest.mark.parametrize("words", [1, 2, 3, 4])
def test_suffix_array_and_intervals(words):
    rng = np.random.default_rng(words)
    seq = np.append(rng.integers(0, 4, 300), 0)
    order = phrases.suffix_array(seq, words)
    keys = [tuple(phrases.later(seq, k)[i] for k in range(words)) for i in order]
    assert keys == sorted(keys) and sorted(order) == list(range(len(seq)))
    first, sizes = phrases.intervals(seq, order, phrases.shared_words(seq, order, words), words)
    want = collections.Counter(k for k in keys if all(k))
    assert {tuple(seq[i : i + words].tolist()): int(n) for i, n in zip(first, sizes)} == {tuple(map(int, k)): n for k, n in want.items()}


def test_words_of():
    seq, words = phrases.words_of(pa.array(["Ab  c.", "", "c\tAB", ",;"]))
    assert [words[int(k) - 1].as_py() if k else None for k in seq] == ["ab", "c", None, "c", "ab", None]


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    found = con.execute(registry.ORACLE_SQL["op13_phrases"])
    columns = [c[0] for c in found.description]
    got = registry.QUERIES["op13_phrases"](spark, SF)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(found.fetchall())
