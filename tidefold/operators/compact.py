"""Compaction, checkpoints and backups as rewrites of the log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import DEL
from ..shared import numbered
from . import fold


class CompactionRefused(RuntimeError):
    """A peer may still pull the records that compaction drops."""


def compacted(ops: DataFrame, now_ms: int, policy: str = "lww", mode: str = "merge") -> DataFrame:
    """ns, key, hlc, replica, value, expires_at, tag, seq: retained live versions in key order, then
    a tombstone for each deleted key that has none; seq starts again at 1 in every namespace.

    The new seq is a running number along each namespace, which is range-partitioned by key (see
    `shared.numbered`), so no namespace is sorted in one task, whatever its keys begin with.
    """
    kept = fold.lww(ops, mode) if policy == "lww" else fold.register_versions(ops, mode)
    kept = kept.where(fold.live(now_ms)).select(
        "ns", "key", "hlc", "replica", "value", "expires_at", "seq", "pos",
        F.when(F.col("expires_at") == 0, 1).otherwise(3).alias("tag"),
    )
    dead = (
        fold.tombstones(ops)
        .join(kept.select("ns", "key").distinct(), ["ns", "key"], "left_anti")
        .select(
            "ns", "key", F.lit(0).cast("long").alias("hlc"), F.lit(None).cast(kept.schema["replica"].dataType).alias("replica"),
            F.lit(None).cast(kept.schema["value"].dataType).alias("value"), F.lit(0).cast("long").alias("expires_at"),
            F.col("last_del").alias("seq"), F.lit(0).alias("pos"), F.lit(2).alias("tag"),
        )
    )
    rows = kept.unionByName(dead)
    return numbered(rows, ["ns"], ["key", "seq", "pos"], "_place").withColumn("seq", F.col("_place")).drop("_place", "pos")


def guard(peer_clocks: DataFrame) -> None:
    if not peer_clocks.isEmpty():
        raise CompactionRefused("a peer clock is recorded")


def retained(ops: DataFrame, policy: str = "lww", mode: str = "merge") -> DataFrame:
    """The operations that any later fold can need, tombstones included: in merge mode the puts that can
    still be seen and a tombstone of each deleted key (the newest), in local mode the last operation of
    each key, or for registers its last tombstone and what came after."""
    if policy == "lww" and mode == "local":
        return fold.top_per_key(ops, fold.BY_LOG)
    dead = fold.top_per_key(ops.where(F.col("tag") == DEL), fold.BY_LOG)
    if policy == "lww":
        alive = fold.top_per_key(fold.puts(ops), fold.BY_CLOCK)
        return alive.join(dead.select("ns", "key"), ["ns", "key"], "left_anti").select(*ops.columns).unionByName(dead)
    last = dead.select("ns", "key", F.struct(*fold.BY_LOG).alias("_del"))
    alive = fold.puts(ops).join(last, ["ns", "key"], "left")
    alive = alive.where("_del is null" if mode == "merge" else "_del is null or struct(seq, pos) > _del")
    return alive.select(*ops.columns).unionByName(dead)


def checkpoint(ops: DataFrame, path: str, policy: str = "lww", mode: str = "merge") -> None:
    """A versioned snapshot: the file commit protocol makes it visible as a whole or not at all."""
    retained(ops, policy, mode).write.mode("errorifexists").partitionBy("ns").parquet(path)


def with_tail(snapshot: DataFrame, tail: DataFrame) -> DataFrame:
    """Operations equal in effect to the whole log: what the snapshot retained and what came after."""
    return snapshot.select(*tail.columns).unionByName(tail)


def backup(log: DataFrame, target: str) -> None:
    """Copy of a log table; refuses an existing target, as does restoring."""
    log.write.mode("errorifexists").partitionBy("ns").parquet(target)


#: Putting a backup back is the same copy the other way.
restore = backup
