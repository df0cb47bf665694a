"""Keyed state over streams cut into batches in several ways, and generation that stops and goes on."""

import datetime

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import models
from sparkloom.streaming import events as S
from sparkloom.streaming import generation as G
from sparkloom.streaming import jobs as J

DAY = datetime.datetime(2024, 1, 1)


def at(minutes):
    return DAY + datetime.timedelta(minutes=minutes)


def streamed(spark, rows, schema, path, batches):
    """Rows as files, one a batch, in order."""
    for k in range(batches):
        part = rows[k * len(rows) // batches : (k + 1) * len(rows) // batches]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{path}/{batches}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{path}/{batches}")


JOBS = "event_id long, job_id long, ts timestamp, status string"


@pytest.mark.parametrize("batches", [1, 4])
def test_gate(spark, tmp_path, batches):
    steps = [
        (1, 1, "pending"), (1, 2, "pending"), (2, 3, "pending"), (3, 1, "failed"), (3.5, 1, "failed"), (5, 1, "failed"), (9, 1, "failed"), (20, 1, "failed"), (21, 1, "completed"),
        (30, 2, "failed"), (31, 5, "completed"), (31, 5, "completed"), (32, 3, "failed"), (40, 3, "completed"), (41, 4, "pending"), (1000, 9, "running"),
    ]
    rows = [(k, job, at(m), status) for k, (m, job, status) in enumerate(steps)]
    needs = spark.createDataFrame([(2, 1, "completion"), (3, 5, "success"), (3, 1, "completion"), (4, 5, "success"), (4, 7, "success")], "job_id long, needs long, kind string")
    got = S.drained(J.gated(streamed(spark, rows, JOBS, tmp_path, batches), needs, most=3, wait=60, late="10 minutes"), "append").collect()
    want = [
        (1, "start", 1), (1, "retry", 4), (1, "retry", 7), (1, "retry", 13), (1, "gave up", 20),
        (2, "start", 3), (2, "retry", 31),
        (3, "start", 31), (3, "retry", 33), (3, "completed", 40),
    ]
    assert sorted((r.job_id, r.action, r["at"]) for r in got) == sorted((j, a, at(m)) for j, a, m in want)


@pytest.mark.parametrize("batches", [1, 5])
def test_breaker(spark, tmp_path, batches):
    steps = [(0, True), (1, False), (2, False), (3, True), (4, False), (5, False), (6, False), (7, True), (66, True), (66.5, False), (67, False), (68, False), (70, True), (400, True)]
    rows = [(k, "svc", at(m), ok) for k, (m, ok) in enumerate(steps)]
    rows.append((99, "other", at(401), False))
    calls = streamed(spark, rows, "call_id long, service string, ts timestamp, ok boolean", tmp_path, batches)
    got = S.drained(J.breaker(calls, 3, 3600, "10 minutes"), "append").where("service = 'svc'").collect()
    shown = sorted((r["at"], -1 if r.call_id is None else r.call_id, r.allowed, r.state) for r in got)
    opened = [(at(66), -1, None, "half_open"), (at(128), -1, None, "half_open")]
    want = [(at(m), k, not refused, state) for (k, (m, _)), refused, state in zip(enumerate(steps), [False] * 7 + [True] + [False] * 4 + [True, False], ["closed"] * 6 + ["open"] * 2 + ["closed"] * 3 + ["open"] * 2 + ["closed"])]
    assert shown == sorted(want + opened)


def test_generation_goes_on(spark, tmp_path):
    """Stopped in its second batch and again in its third, repeated after the end: every chunk once."""
    chunks, out = str(tmp_path / "chunks"), str(tmp_path / "out")
    spark.createDataFrame([(k, f"c{k}") for k in range(40)], "chunk_id long, chunk string").repartition(4).write.parquet(chunks)
    asked = []
    entries = G.qa_generator(lambda prompts: [f'[{{"question": "q {p}", "answer": "a"}}, {{"question": "r {p}", "answer": "b"}}, {{"question": "s", "answer": "c"}}]' for p in prompts], F.col("chunk"), 2)

    def failing(after):
        def generate(batch):
            asked.append(batch.count())
            found = entries(batch)
            if len(asked) == after:
                return found.withColumn("answer", F.raise_error(F.lit("stopped")))
            return found

        return generate

    for after in (2, 4):
        with pytest.raises(Exception, match="stopped"):
            G.generate(spark, chunks, out, failing(after))
    assert G.progress(spark, chunks, out).first().processed < 40
    got = G.generate(spark, chunks, out, failing(0))
    assert sorted((r.chunk_id, r.entry_index, r.question) for r in got.collect()) == sorted((k, j, f"{'qr'[j]} c{k}") for k in range(40) for j in (0, 1))
    assert G.generate(spark, chunks, out, failing(0)).count() == 80 and len(asked) == 6
    assert G.progress(spark, chunks, out).first().share == 1.0


def test_generation_stops_after_its_time(spark, tmp_path):
    import time

    chunks, out = str(tmp_path / "chunks"), str(tmp_path / "out")
    spark.createDataFrame([(k, "x") for k in range(6)], "chunk_id long, chunk string").repartition(6).write.parquet(chunks)

    def slow(batch):
        time.sleep(1.5)
        return batch

    first = G.generate(spark, chunks, out, slow, 1, 5).count()
    assert 0 < first < 6 and G.generate(spark, chunks, out, lambda b: b).count() == 6


def test_null_replies_give_empty_entries(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x")], "chunk_id long, chunk string")
    assert G.qa_generator(models.echo, F.col("chunk"))(rows).first().answer is not None


def test_job_states_over_several_batches(spark, tmp_path):
    """A job's rows that reach Python in several batches are taken in the order of their times all the same."""
    at = datetime.datetime(2024, 1, 1)
    moves = ["pending", "running", "failed", "retrying"] + ["running", "failed"] * 20 + ["running", "completed"]
    rows = [(k, 1, at + datetime.timedelta(seconds=k), status) for k, status in enumerate(moves)]
    spark.createDataFrame(rows[::-1], "event_id long, job_id long, ts timestamp, status string").coalesce(1).write.parquet(str(tmp_path / "jobs"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        stream = spark.readStream.schema("event_id long, job_id long, ts timestamp, status string").parquet(str(tmp_path / "jobs"))
        assert [tuple(r) for r in S.drained(S.job_states(stream), "update").collect()] == [(1, "completed", len(moves), 0)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
