"""Chunks over a document's files against a plain fold, file by file."""

import random
import re

import pytest

from sparkloom.operators import chunking as C

FILES = "document_id string, file_seq int, main_content string, overlap_content string"


def fold(texts, cut, unfinished):
    carry, out = "", []
    for k, t in enumerate(texts):
        t = t or ""
        gap = " " if carry and t and carry[-1] not in C.WHITE and t[0] not in C.WHITE else ""
        chunks = cut(carry + gap + t)
        carry = chunks.pop() if chunks and k + 1 < len(texts) and unfinished(chunks[-1]) else ""
        out += chunks
    return out


def windows(size, overlap):
    return lambda s: [s[k : k + size] for k in range(0, len(s), size - overlap)] if s.strip() else []


def words(size, overlap):
    return lambda s: [" ".join(s.split()[k : k + size]) for k in range(0, len(s.split()), size - overlap)]


CASES = [
    (C.Character(10), windows(10, 0), lambda c: len(c) < 8),
    (C.Character(10, 3), windows(10, 3), lambda c: len(c) < 8),
    (C.Character(7, 1), windows(7, 1), lambda c: len(c) < 5.6),
    (C.Token(4), words(4, 0), lambda c: len(c.split()) < 3.2),
    (C.Token(6, 2), words(6, 2), lambda c: len(c.split()) < 4.8),
    (C.Delimiter("."), lambda s: [x.strip() for x in s.split(".") if x.strip()], lambda c: not c.endswith(".")),
    (C.Schema((C.Rule("pattern", "#", True),)), lambda s: [x.strip() for x in re.split("(?=#)", s) if x.strip()], lambda c: c.startswith("#") and c.count("#") <= 1),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_against_a_fold(spark, case):
    strategy, cut, unfinished = CASES[case]
    rng = random.Random(case)
    text = lambda: "".join(rng.choice(["a", "bc", " ", "\n", ".", "#", "é ", "  ", "word "]) for _ in range(rng.choice([0, 1, 2, 3, 8, 30])))
    docs = {f"d{k}": [rng.choice([text(), text(), None, "   "]) for _ in range(rng.randint(1, 12))] for k in range(30)}
    rows = [(d, 10 * k + 3, t, None) for d, texts in docs.items() for k, t in enumerate(texts)]
    rng.shuffle(rows)
    got = {}
    for r in C.cross_file(spark.createDataFrame(rows, FILES), strategy).collect():
        got.setdefault(r.document_id, []).append((r.chunk_index, r.chunk))
    want = {d: list(enumerate(fold(texts, cut, unfinished), 1)) for d, texts in docs.items()}
    assert {d: sorted(c) for d, c in got.items()} == {d: c for d, c in want.items() if c}


def test_one_document_of_many_files(spark):
    """A document of 3,000 files is no single task's texts; nothing of it is lost."""
    texts = [f"part {k} of one." + " more" * (k % 7) for k in range(3000)]
    files = spark.createDataFrame([("d", k, t, None) for k, t in enumerate(texts)], FILES)
    got = [r.chunk for r in sorted(C.cross_file(files, C.Character(100)).collect(), key=lambda r: r.chunk_index)]
    assert got == fold(texts, windows(100, 0), lambda c: len(c) < 80)
    assert C.cross_file(files.limit(0), C.Character(100)).count() == C.cross_file(files.limit(0), C.Delimiter()).count() == 0


def test_rounds_write_texts_once_and_no_chunks(spark, monkeypatch):
    """What is written between rounds are ends of files, not the chunks of all of them."""
    from sparkloom.operators import chunking

    seen, kept = [], chunking.kept
    monkeypatch.setattr(chunking, "kept", lambda df: (seen.append(df.columns), kept(df))[1])
    rows = spark.createDataFrame([("d", k, f"part {k}.\nrest {k}") for k in range(6)], "document_id string, file_seq int, main_content string")
    got = chunking.cross_file(rows, chunking.Delimiter(".\n")).orderBy("chunk_index").collect()
    assert [r.chunk for r in got] == ["part 0", *[f"rest {k - 1} part {k}" for k in range(1, 6)], "rest 5"]
    assert sum("t" in c for c in seen) == 1 and not any("chunks" in c for c in seen)


def test_no_window_moves_texts(spark, tmp_path):
    """Documents are ordered by id without numbering whole texts; ids that repeat or are null lose nothing."""
    from sparkloom.plans import q_chunking

    def put(name, rows):
        spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        return f"{tmp_path}/{name}"

    rows = [(None, "s", "a b c"), (2, "s", "d " * 150), (1, "s", "x " * 70), (2, "r", "y")]
    found = q_chunking.chunk_cross_file_token(spark, put("plain", rows))
    assert "row_number" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = sorted(tuple(r) for r in found.collect())
    assert got == [("r", 1, "y")] + [("s", k, c) for k, c in enumerate(fold(["a b c", "x " * 70, "d " * 150], words(64, 8), lambda c: len(c.split()) < 51.2), 1)]
    twice = q_chunking.chunk_cross_file_token(spark, put("twice", [(2, "r", "y"), (2, "r", "y"), (3, "r", "z")])).collect()
    assert [tuple(r) for r in twice] == [("r", 1, "y y z")]
