"""From log records to data operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import BATCH

_FIELDS = ["tag", "key", "hlc", "replica", "author", "value", "expires_at"]


def under(log: DataFrame, wanted: Column) -> DataFrame:
    """OPS of the keys that meet a condition on `key`. The condition goes to the log's scan first, where
    only batches pass it unseen, and to their operations afterwards."""
    return explode_batches(log.where((F.col("tag") == BATCH) | wanted)).where(wanted)


def explode_batches(log: DataFrame) -> DataFrame:
    """OPS: batch records exploded in order; records of definitions (schema, index) are left out."""
    single = F.array(F.struct(*[F.col(c) for c in _FIELDS]))
    ops = log.select("ns", "seq", F.posexplode(F.when(F.col("tag") == BATCH, F.col("ops")).otherwise(single)).alias("pos", "op"))
    return ops.select("ns", "seq", "pos", *[F.col(f"op.{c}").alias(c) for c in _FIELDS]).where(F.col("tag").isin(1, 2, 3))
