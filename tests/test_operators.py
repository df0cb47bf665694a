"""Edge cases of operators: empty frames, nulls, blanks, ties, single rows; properties and known numbers."""

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import replies as P
from sparkloom.functions import text as X
from sparkloom.operators import chunking as C
from sparkloom.operators import evaluation as E
from sparkloom.operators import models as M
from sparkloom.operators import quality as Q
from sparkloom.operators import records as R
from sparkloom.operators import sampling as S
from sparkloom.operators import search as Z
from sparkloom.operators import stats as T
from sparkloom.operators import taxonomy as Y
from sparkloom.sources import readers, writers

TEXTS = [None, "", "   ", "short", "exactly ten", "é ß 😀 astral", "One. Two! Three? Therefore four.", "# HEAD\nbody text here", "a" * 25]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy(*columns[:2]).collect()]


def test_character_chunks_join_to_the_text(docs):
    got = rows(C.chunk(docs, C.Character(7, 0)), "doc_id", "chunk_index", "chunk")
    for k, t in enumerate(TEXTS):
        assert "".join(c for d, _, c in got if d == k) == (t or "" if (t or "").strip() else "")
    over = rows(C.chunk(docs, C.Character(10, 3)), "doc_id", "chunk_index", "chunk")
    assert [c for d, _, c in over if d == 8] == ["a" * 10, "a" * 10, "a" * 10, "a" * 4]


def test_other_chunkers(docs):
    assert rows(C.chunk(docs, C.Token(2, 1)), "doc_id", "chunk_index", "chunk")[:1] == [(3, 1, "short")]
    assert [c for d, _, c in rows(C.chunk(docs, C.Delimiter("\n")), "doc_id", "chunk_index", "chunk") if d == 7] == ["# HEAD", "body text here"]
    heading = C.Schema((C.Rule("heading"),))
    assert [c for d, _, c in rows(C.chunk(docs, heading), "doc_id", "chunk_index", "chunk") if d == 7] == ["# HEAD", "body text here"]
    both = C.Schema((C.Rule("heading"), C.Rule("delimiter", "\n")), "all")
    assert [c for d, _, c in rows(C.chunk(docs, both), "doc_id", "chunk_index", "chunk") if d == 7] == ["# HEAD", "body text here"]
    seam = C.chunk(docs.withColumn("h", F.array(F.lit("body"))), C.Headings("h"))
    assert [r.chunk for r in seam.where("doc_id = 7").orderBy("chunk_index").collect()] == ["# HEAD", "body text here"]


@pytest.mark.parametrize("make", [lambda: C.Character(0), lambda: C.Token(5, 5), lambda: C.Delimiter(""), lambda: C.Schema(()), lambda: C.Rule("x")])
def test_bad_strategies(make):
    with pytest.raises(ValueError):
        make()


def test_too_large_text_is_refused(docs):
    with pytest.raises(Exception, match="more than 5 bytes"):
        C.chunk(docs, C.Character(5), max_bytes=5).collect()


def test_cross_file_carries_unfinished_chunks(spark):
    files = spark.createDataFrame([("d", 1, "x" * 15), ("d", 2, "y" * 3), ("d", 3, None), ("e", 1, "z")], "document_id string, file_seq long, main_content string")
    got = rows(C.cross_file(files, 10), "document_id", "chunk_index", "chunk")
    assert got == [("d", 1, "x" * 10), ("d", 2, "xxxxx yyy"), ("e", 1, "z")]


def test_page_splits(spark):
    got = rows(C.page_splits(spark.createDataFrame([("a", 20), ("b", 21), ("c", 39), ("d", 0)], "f string, n int"), "n", 20, 2), "f", "chunk_number", "start_page", "end_page", "prev_chunk", "next_chunk")
    assert got == [("a", 1, 1, 20, None, None), ("b", 1, 1, 20, None, 2), ("b", 2, 19, 21, 1, None), ("c", 1, 1, 20, None, 2), ("c", 2, 19, 38, 1, 3), ("c", 3, 37, 39, 2, None)]


def test_text_functions(spark, docs):
    t = F.col("text")
    got = docs.select(X.sentence_count(t).alias("s"), X.syllable_count(t).alias("y"), X.flesch(t).alias("f"), X.complexity(t).alias("c"), X.coherence(t).alias("h"), X.information_density(t).alias("d")).collect()
    assert [r.s for r in got] == [0, 0, 0, 1, 1, 1, 4, 1, 1] and got[0].f == 50.0 and got[0].c is None and got[2].d == 0.0
    assert all(0 <= r.f <= 100 and 0 <= r.h <= 1 for r in got)
    one = spark.range(1).select(X.jaccard(F.array(), F.array()).alias("a"), X.jaccard(F.array(F.lit("x")), F.array().cast("array<string>")).alias("b"), X.semver(F.lit("1.20.3")).alias("v"), X.semver(F.lit("1.2")).alias("w"), X.top_frequency(F.array(*map(F.lit, "abcab"))).alias("t")).first()
    assert (one.a, one.b, tuple(one.v), one.w, one.t) == (1.0, 0.0, (1, 20, 3), None, 2)


QA = "question string, answer string, category string"


def test_quality_of_nothing_and_of_one(spark):
    for data in ([], [("What is it?", "It is one thing.", "")], [(None, None, None)]):
        got = Q.report(spark.createDataFrame(data, QA)).collect()
        assert len(got) == 4 and all(r.score is not None for r in got)


def test_bias_of_balanced_entries(spark):
    got = Q.bias(spark.createDataFrame([("q", "a b", c) for c in "xy"] * 2, QA)).first()
    assert (got.gini, got.content_bias, got.representation_bias) == (0.0, 1.0, 0.0)


def test_cross_consistency_tiles_agree(spark):
    data = [("q", " ".join("abcdefgh"[k % 8 : k % 8 + 1 + k % 3]), "c" if k % 5 else "d") for k in range(40)]
    entries = spark.createDataFrame(data, QA)
    whole, tiled = (rows(Q.cross_consistency(entries, n), "category", "n_pairs", "mean_jaccard") for n in (1000, 6))
    assert [(a, b, round(c, 9)) for a, b, c in whole] == [(a, b, round(c, 9)) for a, b, c in tiled]


def test_classification(spark):
    pairs = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (2, 2)], "prediction int, label int")
    got = E.macro(pairs).first()
    assert round(got.f1, 6) == round((0.5 + 0.5 + 1) / 3, 6) and E.accuracy(pairs.limit(0)).first().accuracy == 0.0
    assert E.macro(pairs.limit(0)).first().f1 == 0.0


def test_rouge_l_and_meteor(spark):
    pairs = spark.createDataFrame([("the cat sat", "the cat sat"), (None, "x"), ("a b", "b a")], "prediction string, reference string")
    assert round(E.rouge_l(pairs).first().rougeL_f, 6) == 0.5
    assert 0 < E.meteor_exact(pairs).first().meteor < 1 and E.lcs(list("abcde"), list("xbxdx")) == 2


def test_p_values():
    assert abs(E.p_value(0.5, 10) - 0.1411) < 1e-3 and abs(E.p_value(0.9, 5) - 0.0374) < 1e-3
    assert E.p_value(1.0, 5) == 0.0 and E.p_value(None, 5) is None and E.p_value(0.3, 2) is None


def test_parse_answer_takes_negatives_first(spark):
    answers = spark.createDataFrame([("Unacceptable",), ("acceptable",), ("?",)], "a string")
    assert [r.p for r in answers.select(E.parse_answer(F.col("a"), "cola").alias("p")).collect()] == [0, 1, 0]


@pytest.mark.parametrize(("n", "k"), [(0, 5), (3, 5), (5, 5), (20, 5), (20, 10), (100, 10), (11, 10)])
def test_spread(n, k):
    got = S.spread(n, k)
    assert len(got) == min(n, k) and got == sorted(set(got)) and (not got or (got[0], got[-1]) == (0, n - 1))


def test_splits(spark):
    data = spark.range(1000).withColumn("g", F.when(F.col("id") < 300, "a"))
    counts = {(r.g, r.split): r["count"] for r in S.split(data, "id", 0.2, 0.1, "g").groupBy("g", "split").count().collect()}
    assert counts == {("a", "test"): 60, ("a", "val"): 30, ("a", "train"): 210, (None, "test"): 140, (None, "val"): 70, (None, "train"): 490}
    assert S.split(data.limit(0), "id").count() == 0
    with pytest.raises(ValueError):
        S.split(data, "id", 0.9, 0.2)


TREE_A = {"name": "Root", "confidence_threshold": 0.9, "children": [{"name": "A", "description": "Primary A", "confidence_threshold": 0.9}, {"name": "B", "confidence_threshold": 0.8, "children": [{"name": "Sub B1"}]}]}
TREE_B = {"taxonomy": {"name": "Root", "confidence_threshold": 0.5, "children": [{"name": "A", "description": "Secondary A", "confidence_threshold": 0.95, "children": [{"name": "Sub A1"}]}, {"name": "C"}]}}


def test_merge_of_trees(spark):
    a, b = Y.load(spark, TREE_A), Y.load(spark, TREE_B)
    got = {r.path: r for r in Y.merge(a, b).collect()}
    node = got["Root → A"]
    assert (node.description, node.confidence_threshold, node.merged_from, node.source) == ("Primary A", 0.95, ["secondary"], "merged")
    assert {"Root → B → Sub B1", "Root → C", "Root → A → Sub A1"} <= set(got)
    again = {r.path: r.confidence_threshold for r in Y.merge(Y.merge(a, b), b).collect()}
    assert again == {p: r.confidence_threshold for p, r in got.items()}


def test_tree_helpers(spark):
    a = Y.load(spark, TREE_A)
    assert Y.find_by_name(a, "sub").first().path == "Root → B → Sub B1" and Y.find_by_name(a, "zzz").count() == 0
    assert [r.path for r in Y.resolve(a, "cat_0_1_0").collect()] == ["Root → B → Sub B1"]
    assert Y.confidence(a.limit(0)).first().confidence == 0.7
    many = spark.createDataFrame([("R", "R", 0), *[(f"R → n{k:02}", f"n{k:02}", 1) for k in range(12)]], "path string, name string, depth int")
    found = Y.ids(many, "p").collect()
    assert len({r.node_id for r in found}) == 13
    with pytest.raises(ValueError):
        Y.load(spark, {"name": "x", "children": [{}]})


def test_votes(spark):
    votes = spark.createDataFrame([(1, "b", "c", "X", 0.5), (1, "a", "c", "Y", 0.5), (2, "a", "c", "x", 0.0)], "chunk_id long, classifier string, category string, value string, confidence double")
    assert [tuple(r)[:3] for r in E.vote_ensemble(votes).collect()] == [(1, "c", "Y")]
    assert {r.chunk_id: r.score for r in E.vote_agreement_modal(votes).collect()} == {1: 0.5, 2: 0.5}


RESULT = "id long, job_id long, project_id long, chunk_id long, categories array<string>, confidence double, extracted_data string, created_at timestamp"


def test_search_escapes_wildcards(spark):
    import datetime

    t = datetime.datetime(2024, 1, 1)
    data = spark.createDataFrame([(1, 1, 1, 1, ["a_b"], 0.9, "100% sure", t), (2, 1, 1, 1, ["axb"], 0.9, "100 sure", t), (3, 1, 1, 1, None, None, None, t)], RESULT)
    assert [r.id for r in data.where(Z.predicate("100%")).collect()] == [1]
    assert [r.id for r in data.where(Z.predicate(categories=["a_b"])).collect()] == [1]
    assert T.overall(data.limit(0)).first().total == 0 and Z.page_info(data.limit(0), 1, 10).first().total_pages == 0
    kept = {r.id: r.kept for r in Z.budget_oldest_first(data.where("id < 3").withColumn("created_at", F.col("created_at") + F.make_dt_interval(F.col("id").cast("int"))), 215).collect()}
    assert kept == {1: True, 2: False}


def test_moving_average_is_the_fold(spark):
    values = [5.0, 1.0, 9.0, 2.0]
    ema = values[0]
    for v in values[1:]:
        ema = 0.1 * v + 0.9 * ema
    got = T.moving_average(spark.createDataFrame([("k", i, v) for i, v in enumerate(values)], "k string, i int, v double"), "k", ["i"], "v").first()
    assert abs(got.ema - ema) < 1e-12


def test_replies():
    assert P.repaired('x {a: [1, 2,], "b": "}"} y') == '{"a": [1, 2], "b": "}"}' and P.repaired("none") is None and P.repaired(None) is None


def test_models_retry_and_fall_back(spark, docs):
    def fails(prompts):
        raise RuntimeError("down")

    got = M.apply(docs, X.text(F.col("text")), M.fallback(fails, M.echo), base=0.0).collect()
    assert [r.reply for r in got][3] == "short"
    assert {r.reply for r in M.apply(docs, F.lit("p"), fails, base=0.0).collect()} == {None}
    braces = spark.range(1).select(M.render("Say {chunk} to {who}", {"chunk": F.lit("{who}"), "who": F.lit(None)}).alias("p")).first().p
    assert braces == "Say  to "


def test_metadata(spark):
    docs = spark.createDataFrame([("Title: A long title\nAuthor: Jane Doe!\nDate: 2024-01-02\nKeywords: red, Blue; blue, green, ab\nSource: Journal\nFirst sentence is long. Second one too.", "x/y/my_file.txt"), (None, None)], "text string, path string")
    got = R.metadata(docs, "text", "path").collect()
    assert (got[0].title, got[0].author, got[0].date, got[0].keywords, got[0].origin) == ("A long title", "Jane Doe", "2024-01-02", ["red", "Blue", "green"], "Journal")
    assert got[1].author is None and got[1].keywords == []


def test_files_round_trip(spark, docs, tmp_path):
    for form in ("parquet", "jsonl", "csv"):
        writers.write_dataset(docs.where("text IS NOT NULL"), f"{tmp_path}/{form}", form)
    assert spark.read.parquet(f"{tmp_path}/parquet").count() == spark.read.json(f"{tmp_path}/jsonl").count() == 8
    with pytest.raises(ValueError):
        writers.write_dataset(docs, f"{tmp_path}/no", "no")
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"main_content": "inside"}')
    (tmp_path / "in/b.txt").write_bytes(b"plain \xff text")
    readers.register_parser("json", lambda data: "parsed")
    assert {r.content for r in readers.documents(spark, f"{tmp_path}/in").collect()} == {"parsed", "plain  text"}
    assert "inside" in {r.main_content for r in readers.parsed_files(spark, f"{tmp_path}/in").collect()}


def test_report_text(spark):
    report = Q.report(spark.createDataFrame([("What?", "This.", "a")], QA))
    assert writers.quality_text(report).startswith("Overall score") and "| bias |" in writers.quality_text(report, "markdown")


# -- round 2 -------------------------------------------------------------------------


def test_bpe_chunks_against_the_encoder(spark):
    import base64

    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", " \n", "One short text.", "word é 😀 " * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got: dict = {}
    for r in C.chunk(df, C.Bpe(path, P.PATTERN, 16, 4)).orderBy("k", "chunk_index").collect():
        got.setdefault(r.k, []).append(r.chunk)
    ids = own.encode_ordinary(texts[4])
    assert got == {3: [texts[3]], 4: [own.decode(ids[k : k + 16]) for k in range(0, len(ids), 12)]}


def test_syllables_word_by_word(spark):
    """The count over a whole text is that of its words one by one."""
    import re

    def one(w):
        w = re.sub(r"[^\w]", "", w)
        n = len(re.findall("[aeiouy]+", w))
        return max(1, n - (w.endswith("e") and n > 1)) if w else 0

    texts = ["The eye of an able tree, co-operate! -- brrr a-e _e_ 12 ñandú straße", "", None, "e ee eve evenee shhh", "d'accord l'été naïve x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(X.syllable_count(F.col("t"))).collect()]
    assert got == [sum(one(w) for w in re.split(r"[ \t\n\x0b\f\r]+", (t or "").lower()) if w) for t in texts]


def test_pages_and_schema_and_files(spark, tmp_path):
    from sparkloom.operators import library, search
    from sparkloom.sources import readers

    df = spark.range(25).withColumnRenamed("id", "id")
    assert [len(p) for p in search.pages(df, 10)] == [10, 10, 5] and list(search.pages(df.limit(0))) == []
    assert library.schema_problems(df, {"id": "bigint", "x": "string"}) == ["no column x"] and library.schema_problems(df, {"id": "string"}) == ["id is bigint, not string"]
    for d, name, text in (("a", "extraction_7_x.json", "one"), ("a", "extraction_7_y.json", "two!"), ("b", "z.txt", "three")):
        (tmp_path / d).mkdir(exist_ok=True)
        (tmp_path / d / name).write_text(text)
    assert [r.value for r in readers.first_match(spark, f"file://{tmp_path}/a/extraction_7_*.json").collect()] == ["one"]
    stats = {r.directory[-1]: (r.files, round(r.avg_kb * 1024, 3)) for r in readers.directory_statistics(spark, f"file://{tmp_path}").collect()}
    assert stats == {"a": (2, 3.5), "b": (1, 5.0)}
    spark.createDataFrame([("p", "h", 1)], "premise string, hypothesis string, label int").write.json(f"file://{tmp_path}/mnli/validation_matched.jsonl")
    spark.createDataFrame([("s", 0)], "sentence string, label int").write.parquet(f"file://{tmp_path}/cola/validation.parquet")
    assert [tuple(r) for r in readers.task_split(spark, f"file://{tmp_path}", "mnli").collect()] == [("p [SEP] h", 1)]
    assert [tuple(r) for r in readers.task_split(spark, f"file://{tmp_path}", "cola").collect()] == [("s", 0)]


def test_metadata_by_fixed_patterns(spark):
    from sparkloom.operators import records

    text = "A long heading\n=====\nby: Jane D. Doe\nDate: 3/4/2021 or 2020-01-02\n#### four\n### Third one\n**Bold it** **no**\nkeyword: ;"
    rows = [("A/b_c-d.txt", text), ("x.md", "short\n---\nKeywords: b, B; cc, Data, data"), (None, None)]
    got = records.metadata(spark.createDataFrame(rows, "p string, t string"), "t", "p").collect()
    assert (got[0].title, got[0].author, got[0].date, got[0]["keywords"]) == ("A long heading", "Jane D Doe", "3/4/2021", ["Third one", "Bold it"])
    assert (got[1].title, got[1].author, got[1].date, got[1]["keywords"]) == ("X", None, None, ["Data"])
    assert (got[2].title, got[2].author, got[2]["keywords"]) == ("", None, [])


def test_registered_metric(spark):
    from sparkloom.operators import quality

    entries = spark.createDataFrame([("q one", "a two", "c")], "question string, answer string, category string")
    quality.register_metric("length", lambda e, c: e.agg((F.count("*") * 0.25).alias("score")))
    try:
        rows = {r.metric: r for r in quality.report(entries).collect()}
        assert rows["length"].score == 0.25 and not rows["length"].passed
        assert "length score 0.250 is below the threshold 0.50" in {r.issue for r in quality.issues(quality.report(entries)).collect()}
    finally:
        del quality.METRICS["length"]


def test_tree_as_dictionary(spark):
    tree = {"name": "a", "confidence_threshold": 0.5, "children": [{"name": "b", "children": [{"name": "c"}]}, {"name": "d"}]}
    rows = Y.marked(Y.load(spark, tree), "ai")
    (root,) = Y.to_dict(rows)
    assert root["name"] == "a" and root["source"] == "ai" and [c["name"] for c in root["children"]] == ["b", "d"] and root["children"][0]["children"][0]["name"] == "c"
    assert Y.to_dict(rows.limit(0)) == []


def test_templates_without_categories(spark):
    """Relations without a fitting template give no question; templates for any category come with those of one."""
    rows = spark.createDataFrame([(1, 1, "x", "y", "s {target}", "t", 0.5), (1, 2, None, None, None, "t", 0.5)], "l_orderkey int, l_linenumber int, source_category string, target_category string, source_entity string, target_entity string, confidence double")
    some = spark.createDataFrame([(2, "x", "own {source}", "a"), (1, None, "any {source}", "b"), (3, "z", "never", "c")], "template_id int, category string, question string, answer string")
    got = sorted((r.l_linenumber, r.template_id) for r in R.expand_templates(rows, some, 2).collect())
    assert got == [(1, 1), (1, 2), (2, 1)]
    assert R.expand_templates(rows, some.where("category = 'z'"), 2).count() == 0


def test_tiles_count_frequent_and_rare_words(spark):
    """Words in many pairs of a tile and words in few; the report computes each metric once."""
    from sparkloom.operators import quality

    words = [sorted({f"w{(k * j) % 97}" for j in range(1, 9)} | {"every"} | ({"half"} if k % 2 else set())) for k in range(150)]
    rows = spark.createDataFrame([(k, "q", " ".join(w), "a") for k, w in enumerate(words)], "qa_id int, question string, answer string, category string")
    pairs = [len(set(a) & set(b)) / len(set(a) | set(b)) for i, a in enumerate(words) for b in words[:i]]
    for tile in (1024, 40):
        got = quality.cross_consistency(rows, tile).first()
        assert got.n_pairs == len(pairs) and abs(got.mean_jaccard - sum(pairs) / len(pairs)) < 1e-12
    quality.register_metric("counted", lambda e, c: e.agg(F.avg(F.udf(lambda x: 1.0, "double")("question")).alias("score")))
    try:
        plan = quality.report(rows)._jdf.queryExecution().toString()
    finally:
        del quality.METRICS["counted"]
    assert "FlatMapGroupsInPandas" not in plan and "PythonUDF" not in plan
