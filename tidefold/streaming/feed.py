"""The change feed and live counters as Structured Streaming queries.

The stream's checkpoint is the reader's cursor: a restarted query goes on after the last record it
delivered. Late records always count, so no watermark is used for correctness; state is only dropped
for rate-limit windows, which close.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import fold
from ..schema import LOG

MOST_STREAMS = 256


class TooManyStreams(RuntimeError):
    pass


def read(spark: SparkSession, path: str, since: int = 0, schema: str = LOG, files_per_batch: int = 1000) -> DataFrame:
    """Records of a log table as they are appended, those after `since`."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return stream.where(F.col("seq") > since)


def subscribe(
    log: DataFrame, deliver: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False, every: str = "1 second"
) -> StreamingQuery:
    """Hand each batch of new records to `deliver`; resumable through the checkpoint."""
    if len(log.sparkSession.streams.active) >= MOST_STREAMS:
        raise TooManyStreams
    writer = log.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def backoff_ms(failures: int) -> int:
    """The wait before a reader tries again."""
    return min(1000 * 2 ** min(failures, 5), 30_000)


def window_counts(requests: DataFrame, most: int, window: str, time: str = "ts", late: str = "1 minute") -> DataFrame:
    """Requests and allowed requests per key and tumbling window, for append-mode sinks."""
    return (
        requests.withWatermark(time, late)
        .groupBy("key", F.window(time, window))
        .agg(F.count("*").alias("n_requests"))
        .withColumn("n_allowed", F.least("n_requests", F.lit(most).cast("long")))
    )


def upsert_state(path: Callable[[int], str], spark: SparkSession) -> Callable[[DataFrame, int], None]:
    """A `deliver` that folds each batch into the state of the batch before it (lww, merge mode with
    tombstone rows kept). `path(n)` names version n of the state table; a version is written once, so a
    repeated batch rewrites its own version and nothing else."""

    def deliver(ops: DataFrame, n: int) -> None:
        columns = ["ns", "key", "tag", "hlc", "replica", "seq", "pos", "value", "expires_at"]
        rows = ops.select(*columns)
        if n:
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(path(n - 1)))
        dead = rows.where("tag = 2")
        alive = fold.top_per_key(rows.where("tag <> 2"), fold.BY_CLOCK)
        newest = fold.top_per_key(dead, fold.BY_CLOCK)
        alive.unionByName(newest).write.mode("overwrite").parquet(path(n))

    return deliver


def state_of(rows: DataFrame, now_ms: int) -> DataFrame:
    """What reads see of a state table that upsert_state wrote."""
    dead = rows.where("tag = 2").select("ns", "key")
    return rows.where("tag <> 2").join(dead, ["ns", "key"], "left_anti").where(fold.live(now_ms))
