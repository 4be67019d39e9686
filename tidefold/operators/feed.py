"""Reads of the log itself: heads, ranges, the change feed, clock skew."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codec

MOST_CHANGES = 10_000


def heads(log: DataFrame, namespaces: DataFrame | None = None) -> DataFrame:
    """The last seq of each namespace, and its hash in hex where the records have one; namespaces
    without records have head 0."""
    hashed = [F.lower(F.hex(F.max_by("hash", "seq"))).alias("hash")] if "hash" in log.columns else []
    out = log.groupBy("ns").agg(F.max("seq").alias("head"), *hashed)
    if namespaces is None:
        return out
    named = namespaces.select("ns").join(out, "ns", "left")
    return named.withColumn("head", F.coalesce("head", F.lit(0).cast("long"))).select(*out.columns)


def metrics(log: DataFrame) -> DataFrame:
    """ns, records and bytes of every namespace."""
    return log.groupBy("ns").agg(F.count("*").alias("records"), F.sum(F.coalesce(F.octet_length("value"), F.lit(0))).alias("bytes"))


def log_range(log: DataFrame, first: int, most: int = 0) -> DataFrame:
    """Records from seq `first` on; most 0 means to the end; first 0 gives nothing."""
    rows = log.where((F.col("seq") >= first) & F.lit(first > 0)).orderBy("seq")
    return rows.limit(most) if most else rows


def changes(log: DataFrame, since: int, most: int = MOST_CHANGES) -> DataFrame:
    """The change feed after a seq, oldest first, cut at `most` records."""
    return log.where(F.col("seq") > since).orderBy("seq").limit(most)


def change_fields(log: DataFrame) -> DataFrame:
    """Feed rows as clients see them: a batch is one change with its number of operations. A record
    whose payload could not be parsed (no key, and no batch) has parse_error and nothing else."""
    batch, bad = F.col("tag") == 6, F.col("key").isNull() & F.col("ops").isNull()
    text = lambda c: codec.base64_text(F.coalesce(F.col(c).cast("binary"), F.lit(b"")))
    fields = {
        "key_b64": text("key"), "value_b64": text("value"), "del": F.col("tag") == 2, "ttl": F.coalesce("expires_at", F.lit(0)) != 0,
        "expires_at": F.coalesce("expires_at", F.lit(0)), "hlc": F.coalesce("hlc", F.lit(0)), "batch": batch,
        "ops": F.when(batch, F.size("ops")).otherwise(0).cast("long"),
    }
    return log.select("ns", "seq", *[F.when(~bad, c).alias(n) for n, c in fields.items()], bad.alias("parse_error"))


def skew_median(samples: DataFrame, last: int = 8) -> DataFrame:
    """peer, t, skew -> the upper median of the last samples of each peer at every sample."""
    w = Window.partitionBy("peer").orderBy("t").rowsBetween(1 - last, 0)
    recent = F.sort_array(F.collect_list("skew").over(w))
    return samples.select("peer", "t", F.element_at(recent, (F.floor(F.size(recent) / 2) + 1).cast("int")).alias("skew_median"))


def clock_skew(peer_clocks: DataFrame, host: str) -> DataFrame:
    """The estimate for a peer, not below 0."""
    return peer_clocks.where(F.col("peer") == host).select(F.greatest("skew", F.lit(0).cast("long")).alias("skew"))
