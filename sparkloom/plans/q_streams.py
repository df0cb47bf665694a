"""Queries that run a stream to its end and must equal the batch result."""

from pyspark.sql import functions as F

from ..operators import models as M
from ..session import scratch, table
from ..streaming import events as S
from ..streaming import generation as G
from ..streaming import jobs as J
from .catalog import query


def events(spark, d):
    return S.source(spark, f"{d}/events.parquet")


@query("stream_tumbling", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, d):
    return S.drained(S.tumbling(events(spark, d))).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("stream_sliding", "SELECT start, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS start FROM events) GROUP BY start")
def stream_sliding(spark, d):
    return S.drained(S.sliding(events(spark, d))).select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("stream_session", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_session(spark, d):
    return S.drained(S.sessions(events(spark, d))).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("stream_dedup", "SELECT DISTINCT event_id FROM events")
def stream_dedup(spark, d):
    """Every event sent twice comes out once."""
    once = events(spark, d).select("event_id", "ts")
    return S.drained(S.unique(once.withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2))))), "append").select("event_id")


MOVES = "CASE a.status WHEN '' THEN ['pending', 'scheduled', 'running'] WHEN 'pending' THEN ['scheduled', 'running', 'cancelled'] WHEN 'scheduled' THEN ['running', 'cancelled'] WHEN 'running' THEN ['completed', 'failed', 'cancelled'] WHEN 'failed' THEN ['retrying', 'pending', 'running'] WHEN 'retrying' THEN ['running', 'failed', 'cancelled'] ELSE [] END"


@query("stream_job_states", f"""WITH o AS (SELECT job_id, list(status ORDER BY ts, event_id) AS x FROM v_job_events GROUP BY job_id),
f AS (SELECT job_id, list_reduce(x, lambda a, s: CASE WHEN list_contains({MOVES}, s) THEN {{'status': s, 'accepted': a.accepted + 1, 'refused': a.refused}} ELSE {{'status': a.status, 'accepted': a.accepted, 'refused': a.refused + 1}} END,
 {{'status': '', 'accepted': CAST(0 AS BIGINT), 'refused': CAST(0 AS BIGINT)}}) AS r FROM o)
SELECT job_id, nullif(r.status, '') AS status, r.accepted AS accepted, r.refused AS refused FROM f""")
def stream_job_states(spark, d):
    status = F.when(F.col("event_type") == "signup", "pending").when(F.col("event_type") == "view", "running").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("cancelled")
    jobs = events(spark, d).select("event_id", F.col("user_id").alias("job_id"), "ts", status.alias("status"))
    return S.drained(S.job_states(jobs), "update")


EPOCH = "epoch_us(ts)"
STATUS = "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'cancelled' END"
NEEDS = "SELECT DISTINCT user_id AS job_id, user_id - 1 AS needs, 'success' AS kind FROM events WHERE user_id % 2 = 0 UNION ALL SELECT DISTINCT user_id, user_id - 2, 'completion' FROM events WHERE user_id % 3 = 0"


@query("stream_job_gate", f"""WITH e AS (SELECT event_id, user_id AS job_id, {EPOCH} AS ts, {STATUS} AS status FROM events), n AS ({NEEDS}),
met AS (SELECT n.job_id, n.needs, n.kind, min(e.ts) AS ts FROM n LEFT JOIN e ON e.job_id = n.needs AND (e.status = 'completed' OR n.kind = 'completion' AND e.status IN ('failed', 'cancelled')) GROUP BY ALL),
s AS (SELECT e.job_id, min(ts) AS ts FROM e WHERE status = 'pending' GROUP BY ALL),
g AS (SELECT s.job_id, greatest(s.ts, coalesce(max(met.ts), 0)) AS start FROM s LEFT JOIN met USING (job_id) GROUP BY s.job_id, s.ts HAVING count(*) FILTER (WHERE met.job_id IS NOT NULL AND met.ts IS NULL) = 0),
o AS (SELECT g.job_id, list({{'ts': e.ts, 'status': e.status}} ORDER BY e.ts, e.event_id) FILTER (WHERE e.status IS NOT NULL) AS x, any_value(start) AS start FROM g LEFT JOIN e ON e.job_id = g.job_id AND e.ts > g.start AND e.status IN ('failed', 'completed') GROUP BY g.job_id),
f AS (SELECT job_id, start, list_reduce(list_prepend({{'due': CAST(-1 AS BIGINT), 'retries': 0, 'done': FALSE, 'out': []::STRUCT(action VARCHAR, t BIGINT)[]}}, list_transform(coalesce(x, []), lambda v: {{'due': v.ts, 'retries': CASE v.status WHEN 'failed' THEN 1 ELSE 0 END, 'done': FALSE, 'out': []::STRUCT(action VARCHAR, t BIGINT)[]}})),
 lambda a, v: CASE WHEN a.done THEN a ELSE list_transform([CASE WHEN a.due >= 0 AND a.due <= v.due THEN {{'due': CAST(-1 AS BIGINT), 'retries': a.retries, 'done': FALSE, 'out': list_append(a.out, {{'action': 'retry', 't': a.due}})}} ELSE a END], lambda b:
  CASE WHEN v.retries = 0 THEN {{'due': CAST(-1 AS BIGINT), 'retries': b.retries, 'done': TRUE, 'out': list_append(b.out, {{'action': 'completed', 't': v.due}})}}
       WHEN b.due >= 0 THEN b
       WHEN b.retries < 3 THEN {{'due': v.due + 3600000000 * CAST(power(2, b.retries) AS BIGINT), 'retries': b.retries + 1, 'done': FALSE, 'out': b.out}}
       ELSE {{'due': CAST(-1 AS BIGINT), 'retries': b.retries, 'done': TRUE, 'out': list_append(b.out, {{'action': 'gave up', 't': v.due}})}} END)[1] END) AS r FROM o),
w AS (SELECT max({EPOCH}) - 7200000000 AS mark FROM events)
SELECT job_id, 'start' AS action, start AS at_us FROM g UNION ALL SELECT job_id, u.action, u.t AS at_us FROM (SELECT job_id, unnest(r.out) AS u FROM f) UNION ALL SELECT job_id, 'retry', r.due FROM f, w WHERE r.due >= 0 AND r.due <= mark""")
def stream_job_gate(spark, d):
    """Jobs that wait for others, and are tried again after one, two and four hours."""
    status = F.when(F.col("event_type") == "signup", "pending").when(F.col("event_type") == "view", "running").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("cancelled")
    jobs = events(spark, d).select("event_id", F.col("user_id").alias("job_id"), "ts", status.alias("status"))
    users = table(spark, d, "events").select(F.col("user_id").alias("job_id")).distinct()
    needs = users.where("job_id % 2 = 0").select("job_id", (F.col("job_id") - 1).alias("needs"), F.lit("success").alias("kind")).unionByName(users.where("job_id % 3 = 0").select("job_id", (F.col("job_id") - 2).alias("needs"), F.lit("completion").alias("kind")))
    return S.drained(J.gated(jobs, needs, wait=3600), "append").select("job_id", "action", F.unix_micros("at").alias("at_us"))


@query("stream_circuit_breaker", f"""WITH o AS (SELECT CAST(user_id % 50 AS VARCHAR) AS service, list({{'id': event_id, 'ts': {EPOCH}, 'ok': event_type NOT IN ('error', 'view')}} ORDER BY ts, event_id) AS x FROM events GROUP BY 1),
f AS (SELECT service, list_reduce(list_prepend({{'state': 'closed', 'failed': 0, 'due': CAST(-1 AS BIGINT), 'out': []::STRUCT(call_id BIGINT, allowed BOOLEAN, state VARCHAR, t BIGINT)[]}}, list_transform(x, lambda v: {{'state': CASE WHEN v.ok THEN 'ok' ELSE 'no' END, 'failed': CAST(v.id AS INT), 'due': v.ts, 'out': []::STRUCT(call_id BIGINT, allowed BOOLEAN, state VARCHAR, t BIGINT)[]}})),
 lambda a, v: list_transform([CASE WHEN a.state = 'open' AND a.due <= v.due THEN {{'state': 'half_open', 'failed': a.failed, 'due': CAST(-1 AS BIGINT), 'out': list_append(a.out, {{'call_id': NULL, 'allowed': NULL, 'state': 'half_open', 't': a.due}})}} ELSE a END], lambda b:
  CASE WHEN b.state = 'open' THEN {{'state': 'open', 'failed': b.failed, 'due': b.due, 'out': list_append(b.out, {{'call_id': v.failed, 'allowed': FALSE, 'state': 'open', 't': v.due}})}}
       WHEN v.state = 'ok' THEN {{'state': 'closed', 'failed': 0, 'due': CAST(-1 AS BIGINT), 'out': list_append(b.out, {{'call_id': v.failed, 'allowed': TRUE, 'state': 'closed', 't': v.due}})}}
       WHEN b.failed >= 2 THEN {{'state': 'open', 'failed': b.failed + 1, 'due': v.due + 14400000000, 'out': list_append(b.out, {{'call_id': v.failed, 'allowed': TRUE, 'state': 'open', 't': v.due}})}}
       ELSE {{'state': b.state, 'failed': b.failed + 1, 'due': CAST(-1 AS BIGINT), 'out': list_append(b.out, {{'call_id': v.failed, 'allowed': TRUE, 'state': b.state, 't': v.due}})}} END)[1]) AS r FROM o),
w AS (SELECT max({EPOCH}) - 7200000000 AS mark FROM events)
SELECT service, u.call_id, u.allowed, u.state, u.t AS at_us FROM (SELECT service, unnest(r.out) AS u FROM f) UNION ALL SELECT service, NULL, NULL, 'half_open', r.due FROM f, w WHERE r.state = 'open' AND r.due <= mark""")
def stream_circuit_breaker(spark, d):
    """Calls of 50 services behind breakers of three failures and four hours."""
    calls = events(spark, d).select((F.col("user_id") % 50).cast("string").alias("service"), F.col("event_id").alias("call_id"), "ts", (~F.col("event_type").isin("error", "view")).alias("ok"))
    return S.drained(J.breaker(calls, 3, 14400), "append").select("service", "call_id", "allowed", "state", F.unix_micros("at").alias("at_us"))


@query("stream_generation", "SELECT doc_id AS chunk_id, CAST(k AS INT) AS entry_index, 'q' || k || ' of ' || doc_id AS question, 'a' || k AS answer FROM documents, (SELECT unnest([0, 1, 2]) AS k)")
def stream_generation(spark, d):
    """Entries of all chunks, at most three each, generated in two runs: the first stops in its third batch."""
    root = scratch(spark, "generation")
    i = F.col("doc_id").cast("string")
    table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.concat(F.lit("about "), i).alias("chunk")).repartition(8).write.parquet(f"{root}/chunks")
    reply = lambda p: "[" + ",".join(f'{{"question": "q{k} of {p[6:]}", "answer": "a{k}"}}' for k in range(5)) + "]"
    whole = G.qa_generator(lambda prompts: [reply(p) for p in prompts], F.col("chunk"))
    batches = []

    def stopping(chunks):
        batches.append(1)
        if len(batches) == 3:
            raise RuntimeError("stopped")
        return whole(chunks)

    try:
        G.generate(spark, f"{root}/chunks", f"{root}/out", stopping, 2)
    except Exception as e:
        if "stopped" not in str(e):
            raise
    return G.generate(spark, f"{root}/chunks", f"{root}/out", whole, 2).select("chunk_id", "entry_index", "question", "answer")
