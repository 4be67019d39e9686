"""Shared plumbing of the training-data operators: tables, the shared folder, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import cut, discard, fresh_path, small_side, stored

__all__ = ["cut", "discard", "fresh_path", "map_arrow", "map_batches", "small_side", "spread_join", "stored", "table"]

#: Rows of a key that may meet in one task, whatever the size of the table.
HOT_ROWS = 2048
#: Keys that can be hot, since a hot one has more than this share of all rows; they are broadcast.
MOST_HOT = 100_000

#: Bytes of an Arrow batch, in every operator: texts differ in length by orders of magnitude.
BATCH_BYTES = "4m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(
    df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """mapInArrow over batches that hold rows. Their size is a setting of the session, the same in
    all operators."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(lambda batches: fn(b for b in batches if b.num_rows), schema)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply fn to each batch; Spark partitions the work."""
    return map_batches(df, lambda batches: map(fn, batches), schema)


def spread_join(rows: DataFrame, side: DataFrame, keys: list[str], by: str, counts: DataFrame, how: str = "inner") -> DataFrame:
    """rows.join(side, keys, how), how being inner or left, where side has one row of a key and rows may
    have very many. counts: the keys, and n, about how many rows each has. Keys with more than HOT_ROWS
    rows and a MOST_HOT-th of all are dealt in portions, by the hash of `by`, to as many copies of side's
    row."""
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    limit = max(HOT_ROWS, (total or 0) // MOST_HOT)
    if (most or 0) <= limit:
        return rows.join(side, keys, how)
    hot = F.broadcast(counts.where(F.col("n") > limit).select(*keys, F.ceil(F.col("n") / limit).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = rows.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(by), parts).cast("int")).drop("_parts")
    copies = side.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(copies, [*keys, "_salt"], how).drop("_salt")
