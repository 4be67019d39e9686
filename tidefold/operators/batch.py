"""The batch pipeline, quota, rate limits and byte caps over operation tables.

A request batch is a table (ns, idx, op, key, value_b64, schema_error): idx is the place in the
request, and results keep it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codec

MOST_OPS = 1000
MOST_RECORD = 6 << 20
MOST_GET = 8 << 20


def size_estimate(ops: DataFrame) -> DataFrame:
    """Estimated record size of each namespace's batch, before decoding."""
    of = lambda c: F.coalesce(F.octet_length(c), F.lit(0))
    put = 93 + of("key") + F.ceil(of("value_b64") / 4) * 3
    size = F.when(F.col("op") == "put", put).when(F.col("op") == "del", 85 + of("key")).otherwise(0)
    return ops.groupBy("ns").agg(F.sum(size).cast("long").alias("bytes"), F.count("*").alias("n_ops"))


def validated(ops: DataFrame) -> DataFrame:
    """Adds value (decoded) and error (null if sound); a failing operation fails alone."""
    value = codec.base64_bytes(F.col("value_b64"))
    error = (
        F.when(F.col("key").isNull(), "missing_key")
        .when(F.col("op").isNull() | ~F.col("op").isin("put", "get", "del"), "unknown_op")
        .when((F.col("op") == "put") & F.col("value_b64").isNull(), "missing_value_b64")
        .when((F.col("op") == "put") & value.isNull(), "bad_value_b64")
        .when((F.col("op") == "put") & F.col("schema_error").isNotNull(), F.concat(F.lit("schema_violation: "), F.col("schema_error")))
    )
    return ops.withColumn("value", value).withColumn("error", error)


def _greedy(items: Column, limit: int, used: Column) -> Column:
    """A text of one digit for each item in order: 1 if it is granted."""
    start = F.struct(used.cast("long").alias("used"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        ok = acc["used"] + x["cost"] <= limit
        return F.struct(
            (acc["used"] + F.when(ok, x["cost"]).otherwise(0)).alias("used"), F.concat(acc["out"], F.when(ok, "1").otherwise("0")).alias("out")
        )

    return F.aggregate(items, start, step)["out"]


def quota(ops: DataFrame, limit: int) -> DataFrame:
    """ns, idx, ok: greedy quota within each batch. An operation that would exceed the limit is
    refused without being charged, and a later smaller one may pass. A batch has at most MOST_OPS
    operations, so each array is bounded; a longer one is refused as a whole (ok is false)."""
    items = F.sort_array(F.collect_list(F.struct("idx", F.col("cost").cast("long").alias("cost"))))
    counts = ops.groupBy("ns").agg(F.count("*").alias("n"))
    long = counts.where(F.col("n") > MOST_OPS).select("ns")
    got = ops.join(long, "ns", "left_anti").groupBy("ns").agg(items.alias("items"), F.first("used").alias("used"))
    out = got.withColumn("out", _greedy(F.col("items"), limit, F.col("used"))).select("ns", "out", F.posexplode("items").alias("at", "x"))
    granted = out.select("ns", F.col("x.idx").cast("long").alias("idx"), (F.substr("out", F.col("at") + 1, F.lit(1)) == "1").alias("ok"))
    refused = ops.join(long, "ns", "left_semi").select("ns", F.col("idx").cast("long").alias("idx"), F.lit(False).alias("ok"))
    return granted.unionByName(refused)


def byte_cap(gets: DataFrame, cap: int = MOST_GET, group: str = "ns", order: str = "idx") -> DataFrame:
    """Adds over_cap: the first result that passes the cap, and all after it."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return gets.withColumn("over_cap", F.sum(F.coalesce("bytes", F.lit(0))).over(w) > cap)


def rate_limited(requests: DataFrame, most: int, window: int, key: str = "key", time: str = "ms", order: str = "seq") -> DataFrame:
    """Adds allowed: the first `most` requests of a key in each tumbling window of `window` units.
    most 0 or window 0 allows all."""
    if not most or not window:
        return requests.withColumn("allowed", F.lit(True))
    slot = F.floor(F.col(time) / window)
    w = Window.partitionBy(key, slot).orderBy(order)
    return requests.withColumn("allowed", F.row_number().over(w) <= most)


def rate_counts(requests: DataFrame, most: int, window: int, key: str = "key", time: str = "ms") -> DataFrame:
    """key, slot, n_requests, n_allowed: the same as counts, with partial aggregation and no sort."""
    slot = F.floor(F.col(time) / window).cast("long").alias("slot")
    return requests.groupBy(key, slot).agg(F.count("*").alias("n_requests")).withColumn(
        "n_allowed", F.least("n_requests", F.lit(most).cast("long"))
    )


def results(ops: DataFrame, applied_state: DataFrame, seq: int, cap: int = MOST_GET) -> DataFrame:
    """One result per operation by idx: accepted writes share the seq of the batch record, and gets see
    the state after the whole batch."""
    values = applied_state.select("ns", "key", F.col("value").alias("found"))
    joined = ops.join(values, ["ns", "key"], "left").withColumn(
        "bytes", F.when((F.col("op") == "get") & F.col("error").isNull(), F.octet_length("found"))
    )
    capped = byte_cap(joined, cap)
    get = F.col("op") == "get"
    error = F.coalesce("error", F.when(get & F.col("over_cap"), F.lit("batch_get_response_too_large")))
    return capped.select(
        "ns", "idx", "op", "key", error.alias("error"),
        F.when(F.col("op").isin("put", "del") & error.isNull(), F.lit(seq).cast("long")).alias("seq"),
        F.when(get & error.isNull(), codec.base64_text(F.col("found").cast("binary"))).alias("value_b64"),
    )
