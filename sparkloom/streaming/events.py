"""Windows, sessions, duplicates and a job state machine over event streams.

Each function takes a streaming frame and returns one; ``drained`` runs a stream
over what there is now and gives the result as a batch frame.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import scratch


def source(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet folder or file as a stream of its present schema; ts as a timestamp.

    A single file has to be named by a pattern, else Spark looks for a folder.
    """
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]").withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and sum per window and event type."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour", late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """A user's runs of events without a longer gap."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), "n")


def unique(events: DataFrame, key: str = "event_id", late: str = "2 hours") -> DataFrame:
    """Each key once while its first event is within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


#: Statuses a job may take after another.
MOVES = {
    None: ("pending", "scheduled", "running"),
    "pending": ("scheduled", "running", "cancelled"),
    "scheduled": ("running", "cancelled"),
    "running": ("completed", "failed", "cancelled"),
    "failed": ("retrying", "pending", "running"),
    "retrying": ("running", "failed", "cancelled"),
    "completed": (),
    "cancelled": (),
}
JOB = "job_id long, status string, accepted long, refused long"


def _moved(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    status, accepted, refused = state.get if state.exists else (None, 0, 0)
    for new in pd.concat(list(batches)).sort_values(["ts", "event_id"])["status"]:  # a job's rows may come in several batches, in any order
        if new in MOVES.get(status, ()):
            status, accepted = new, accepted + 1
        else:
            refused += 1
    state.update((status, accepted, refused))
    yield pd.DataFrame({"job_id": [key[0]], "status": [status], "accepted": [accepted], "refused": [refused]})


def job_states(events: DataFrame) -> DataFrame:
    """The status of each job after the moves the state machine allows; three values are held per job.

    A task holds the rows that one micro-batch has of one job, to take them in order.
    """
    return events.groupBy("job_id").applyInPandasWithState(_moved, JOB, "status string, accepted long, refused long", "update", GroupStateTimeout.NoTimeout)


STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """The result of a stream over all present input, kept as Parquet in the shared folder."""
    spark = stream.sparkSession
    path = scratch(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        if mode == "complete":
            batch.write.mode("overwrite").parquet(f"{path}/out")
        else:
            batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/out/part={number}")

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)  # timers and maps need it
    query = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.parquet(f"{path}/out")
    return found.drop("_batch", "part")
