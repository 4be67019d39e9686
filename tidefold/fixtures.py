"""Projections of the star-schema tables into key-value shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: 2024-02-01T00:00:00Z, after the last event.
NOW = 1706745600000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_ops(spark: SparkSession, sf_dir: str, by_type: bool = False) -> DataFrame:
    """One operation per event: errors delete, signups expire after a day, the rest put."""
    kind = F.col("event_type")
    # whole milliseconds; the column has no zone and the session's is UTC
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        (kind if by_type else F.lit("events")).alias("ns"),
        (F.col("event_id") + 1).alias("seq"),
        F.lit(0).alias("pos"),
        F.when(kind == "error", 2).when(kind == "signup", 3).otherwise(1).alias("tag"),
        F.concat(F.lit("u/"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("key"),
        (F.shiftleft(ms, 16) + F.col("event_id") % 65536).alias("hlc"),
        F.concat(F.lit("r"), (F.col("event_id") % 3).cast("string")).alias("replica"),
        F.lit("host").alias("author"),
        F.when(kind == "error", "").otherwise(F.col("props")).alias("value"),
        F.when(kind == "signup", ms + 86400000).otherwise(F.lit(0)).cast("long").alias("expires_at"),
        kind.alias("event_type"),
        "event_id",
        ms.alias("ms"),
        F.col("value").alias("event_value"),
    )


def order_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch record per order, with its lines as operations in line order."""
    zero = F.lit(0).cast("long")
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.struct(
            F.col("l_linenumber").alias("line"),
            F.concat_ws("/", F.lit("o"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("key"),
            F.col("l_returnflag").alias("value"),
        ).alias("op"),
    )
    batches = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("op")).alias("lines"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    op = lambda x: F.struct(
        F.lit(1).alias("tag"), x["key"].alias("key"), zero.alias("hlc"), F.lit("r0").alias("replica"), F.lit("host").alias("author"),
        x["value"].alias("value"), zero.alias("expires_at"),
    )
    return orders.join(batches, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.lit("orders").alias("ns"), F.col("o_orderkey").alias("seq"), F.lit(6).alias("tag"), F.lit("").alias("key"), zero.alias("hlc"),
        F.lit("r0").alias("replica"), F.lit("host").alias("author"), F.lit("").alias("value"), zero.alias("expires_at"), F.transform("lines", op).alias("ops"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch request per hundred events: puts, gets and deletes, some of them unsound."""
    e = event_ops(spark, sf_dir)
    n, b64 = F.col("event_id"), F.translate(F.base64(F.col("value").cast("binary")), "=\r\n", "")
    return e.select(
        F.concat(F.lit("b"), F.floor(n / 100).cast("string")).alias("ns"),
        n.alias("idx"),
        F.when(n % 13 == 0, "jump").when(n % 4 == 0, "get").when(n % 4 == 1, "del").otherwise("put").alias("op"),
        F.when(n % 11 != 0, F.col("key")).alias("key"),
        F.when(n % 7 == 0, None).when(n % 9 == 0, F.concat(F.lit("%"), b64)).otherwise(b64).alias("value_b64"),
        F.when(n % 17 == 0, "$: bad").alias("schema_error"),
    )


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files named by their URL without scheme, query and fragment."""
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return table(spark, sf_dir, "pages").select(path.alias("path"), "page_id", F.col("html").alias("value"))
