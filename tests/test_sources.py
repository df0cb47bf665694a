"""The document source and named exports: ranges, handlers, failures, commits."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sparkloom.sources import exports, paged


def load(spark, path, *handlers, **options):
    spark.dataSource.register(paged.document_source(*handlers))
    reader = spark.read.format(paged.FORMAT).option("path", str(path))
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def test_ranges():
    assert paged.ranges(10, 4, 1) == [(0, 4), (3, 7), (6, 10)]
    assert paged.ranges(4, 4, 1) == [(0, 4)] and paged.ranges(1, 200, 1) == [(0, 1)]
    assert paged.ranges(5, 2, 0) == [(0, 2), (2, 4), (4, 5)]


@pytest.mark.parametrize("text", ["", "one line", "é" * 9000, "a\n" * 3000, "\n\n\n", "x" * 100 + "\n" + "y" * 5000 + "\nz"])
def test_pages_are_the_whole_text(text):
    """Every byte is in one page, whatever the lengths of lines."""
    for size in (7, 64, 4096):
        assert "".join(paged.page_texts(text.encode(), size)) == text


def test_one_task_a_range(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"line {k} é\n" for k in range(2000)))
    df = load(spark, tmp_path, page_bytes=1000, pages_per_split=5, overlap_pages=1)
    rows = sorted(df.collect(), key=lambda r: r.split)
    assert df.rdd.getNumPartitions() == len(rows) == 6
    assert "".join(r.content for r in rows) == (tmp_path / "a.txt").read_text()
    assert all(b.overlap and a.content.endswith(b.overlap) for a, b in zip(rows, rows[1:]))
    assert [r.prev_split for r in rows] == [None, 1, 2, 3, 4, 5] and [r.next_split for r in rows] == [2, 3, 4, 5, 6, None]


def test_many_ranges_share_tasks(spark, tmp_path):
    """More ranges, or files that are read whole, than tasks: the same rows from few partitions."""
    (tmp_path / "a.txt").write_text("".join(f"line {k} é\n" for k in range(2000)))
    for k in range(30):
        (tmp_path / f"{k}.json").write_text(f'{{"main_content": "text {k}"}}')
    options = {"page_bytes": 1000, "pages_per_split": 2, "overlap_pages": 1}
    few, many = load(spark, tmp_path, tasks=5, **options), load(spark, tmp_path, tasks=1000, **options)
    assert few.rdd.getNumPartitions() <= 5 and many.rdd.getNumPartitions() == many.count() > 50
    assert sorted(few.collect()) == sorted(many.collect())


def test_a_file_a_row(spark, tmp_path):
    """Files by name, without a folder a file."""
    from sparkloom.sources import writers

    rows = spark.range(100).select(F.concat(F.lit("k="), F.col("id") % 3, F.lit("/"), "id", F.lit(".txt")).alias("name"), F.concat(F.lit("é "), "id").alias("value"))
    assert writers.write_texts(rows, f"file://{tmp_path}") == 100
    assert sorted(os.listdir(tmp_path)) == ["k=0", "k=1", "k=2"] and (tmp_path / "k=2" / "17.txt").read_text() == "é 17\n"


def test_small_files_share_tasks(spark, tmp_path, monkeypatch):
    """The files, paths and texts of Spark's text source, in tasks whose number does not grow with that of the files."""
    import gzip

    import pyarrow as pa

    from sparkloom.sources import readers

    files = {f"part={k % 7}/doc={k}.txt": f"text {k}\r\né".encode() for k in range(40)}
    files |= {"part=1/a b%20c+d#.json": b'{"main_content": "m"}', "part=2/z.txt.gz": gzip.compress(b"zipped"), "other/k=v/é.txt": b"\xef\xbb\xbfbom", "part=4/empty.txt": b"", "part=4/.no": b"x", "part=4/_no": b"x", "part=4/_k=v": b"yes"}
    for name, content in files.items():
        (tmp_path / "of é" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "of é" / name).write_bytes(content)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1")  # as if there were very many
    try:
        for path in ("part=1", "part=2", "other", "part=4", "part=*/doc=?.txt", "part=1/doc=1.txt"):
            whole = spark.read.text(f"{tmp_path}/of é/{path}", wholetext=True).select(F.col("_metadata.file_path").alias("path"), readers.main_content(F.col("value")))
            found = readers.parsed_files(spark, f"{tmp_path}/of é/{path}")
            assert sorted(found.collect()) == sorted(whole.collect()) != []
        every = readers.parsed_files(spark, f"{tmp_path}/of é/part=*")
        assert every.count() == 43 and every.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    with pytest.raises(FileNotFoundError):
        readers.parsed_files(spark, f"{tmp_path}/none")
    monkeypatch.setattr(readers, "BATCH_FILES", 3)
    own = [f"{tmp_path}/of é/part=0/doc={k}.txt" for k in (0, 7, 14, 21, 28)]
    batches = list(readers._contents([pa.RecordBatch.from_pydict({"path": [f"file:{x}" for x in own], "file": own})]))
    assert [len(b) for b in batches] == [3, 2] and batches[1]["value"].to_pylist() == [f"text {k}\r\né".encode() for k in (21, 28)]


def test_handlers_by_path(spark, tmp_path):
    """A handler of a caller's own comes first; JSON, markup and empty results have their fallbacks."""

    class Shouting(paged.Whole):
        suffixes = (".shout",)

        def text(self, content):
            return content.decode().upper()

    class Mute(paged.Whole):
        suffixes = (".mute",)

        def text(self, content):
            return "  "

    (tmp_path / "a.shout").write_text("hi\fyou")
    (tmp_path / "b.json").write_text('{"main_content": "m"}')
    (tmp_path / "c.json").write_text("{broken")
    (tmp_path / "d.html").write_text("<p>a &amp; b</p><style>x</style><div>c\nd</div>")
    (tmp_path / "e.mute").write_text("raw")
    (tmp_path / "f.txt").write_bytes(b"ok\xff\xfe")
    (tmp_path / ".hidden").write_text("no")
    found = load(spark, tmp_path, Shouting(), Mute(), pages_per_split=1, overlap_pages=0).collect()
    rows = {(os.path.basename(r.path), r.split): r.content for r in found}
    assert rows == {("a.shout", 1): "HI", ("a.shout", 2): "YOU", ("b.json", 1): "m", ("c.json", 1): "{broken", ("d.html", 1): "a & b\n\nc\n\nd", ("e.mute", 1): "raw", ("f.txt", 1): "ok"}


def test_modes(spark, tmp_path):
    class Broken(paged.Whole):
        suffixes = (".bad",)

        def text(self, content):
            raise ValueError("no such format")

    (tmp_path / "a.bad").write_text("x")
    (tmp_path / "b.txt").write_text("fine")
    rows = {r.content: r.error for r in load(spark, tmp_path, Broken()).collect()}
    assert rows == {None: "ValueError: no such format", "fine": None}
    assert [r.content for r in load(spark, tmp_path, Broken(), mode="dropmalformed").collect()] == ["fine"]
    with pytest.raises(Exception, match="no such format"):
        load(spark, tmp_path, Broken(), mode="failfast").collect()
    with pytest.raises(Exception, match="need 0 <= overlap_pages"):
        load(spark, tmp_path, pages_per_split=2, overlap_pages=2).collect()


def test_paths(spark, tmp_path):
    """Globs, single files, empty folders; a missing path is an error."""
    (tmp_path / "x").mkdir()
    for name in ("a.txt", "b.txt", "x/c.txt", "x/d.log"):
        (tmp_path / name).write_text(name)
    read = lambda p: sorted(r.content for r in load(spark, p).collect())
    assert read(f"{tmp_path}/*.txt") == ["a.txt", "b.txt", "x/c.txt"] and read(f"{tmp_path}/x/c*") == ["x/c.txt"]
    assert read(f"{tmp_path}/a.txt") == ["a.txt"] and read(f"file://{tmp_path}/x") == ["x/c.txt", "x/d.log"]
    (tmp_path / "y").mkdir()
    assert read(tmp_path / "y") == []
    with pytest.raises(Exception, match="none"):
        read(tmp_path / "none")


def test_filters_skip_partitions(spark, tmp_path):
    (tmp_path / "a.txt").write_text("line\n" * 2000)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = load(spark, tmp_path, page_bytes=1000, pages_per_split=1, overlap_pages=0, prune="true").where("split >= 3 AND split < 6")
        assert df.rdd.getNumPartitions() == 3 and sorted(r.split for r in df.collect()) == [3, 4, 5]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_export_names_and_headers(spark, tmp_path):
    rows = spark.createDataFrame([(2, 'say "x", y', None), (1, "line\nbreak", 0.5)], "id int, name string, confidence_score double")
    exports.export(rows, str(tmp_path), "t.csv", "taxonomies", ("id",))
    assert (tmp_path / "t.csv").read_text() == 'ID,Name,Project_ID,Categories_Count,Confidence_Score,Created_At\n1,"line\nbreak",,0,0.5,Unknown\n2,"say ""x"", y",,0,0.0,Unknown\n'
    exports.export(rows.withColumn("more", F.struct(F.array(F.lit("é")).alias("a"))), str(tmp_path), "t.json", order=("id",))
    assert json.loads((tmp_path / "t.json").read_text())[0] == {"id": 1, "name": "line\nbreak", "confidence_score": 0.5, "more": {"a": ["é"]}}
    exports.export(spark.range(10), str(tmp_path), "n.jsonl", order=("id",), rows_per_file=4)
    names = sorted(p for p in os.listdir(tmp_path) if p.startswith("n"))
    assert names == [f"n-{k:05d}-of-00003.jsonl" for k in (1, 2, 3)]
    assert [json.loads(x)["id"] for p in names for x in (tmp_path / p).read_text().splitlines()] == list(range(10))
    exports.export(spark.range(0), str(tmp_path), "n.jsonl")
    assert [p for p in os.listdir(tmp_path) if p.startswith("n")] == ["n.jsonl"] and (tmp_path / "n.jsonl").read_text() == ""
    assert not [p for p in os.listdir(tmp_path) if p.startswith(".export")]


def test_failed_export_leaves_nothing(spark, tmp_path):
    exports.export(spark.range(3), str(tmp_path), "a.csv", order=("id",))
    before = (tmp_path / "a.csv").read_text()
    bad = spark.range(100).select(F.when(F.col("id") == 99, F.raise_error(F.lit("boom"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="boom"):
        bad.write.format("named_export").option("path", str(tmp_path)).option("name", "a.csv").mode("overwrite").save()
    assert os.listdir(tmp_path) == ["a.csv"] and (tmp_path / "a.csv").read_text() == before
    with pytest.raises(Exception, match="a.csv"):
        exports.export(spark.range(5), str(tmp_path), "a.csv", overwrite=False)
    assert os.listdir(tmp_path) == ["a.csv"] and (tmp_path / "a.csv").read_text() == before


@pytest.mark.parametrize("name", ["export_benchmarks", "export_datasets", "export_filtered", "export_qa", "export_taxonomies"])
def test_exports_of_several_files_are_read_whole(spark, monkeypatch, name):
    """An export of more rows than a file takes is numbered files; the query reads them all."""
    from sparkloom import registry

    whole, export = registry.QUERIES[name](spark, "/root/testdata/sf0.001").collect(), exports.export
    monkeypatch.setattr(exports, "export", lambda *a, **k: export(*a, **k | {"rows_per_file": 2 if name == "export_taxonomies" else 20}))
    assert sorted(map(str, registry.QUERIES[name](spark, "/root/testdata/sf0.001").collect())) == sorted(map(str, whole))
