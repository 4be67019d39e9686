"""The fold of the log: conflict resolution, tombstones, expiry.

Two policies: `lww` keeps one version per key, `register` keeps all. Two modes: `merge`, the default,
gives the same answer for the same set of records in any order of arrival, and any tombstone hides its
key; `local` follows the order of the log, where a later put brings a key back.

A fold shuffles by (ns, key) only. The winner is picked by a ranked window, whose limit Spark
applies before the shuffle, so a key with many versions sends one row per task; deletes are summed up
in each task too, and versions meet their key's last delete in a join, which Spark can split. Expiry is filtered
after the pick for lww (an expired winner hides its key) and before it for register (an older live
version shows again).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DEL, STATE

KEY = ("ns", "key")
BY_CLOCK = ("hlc", "replica", "seq", "pos")
BY_LOG = ("seq", "pos")


def top_per_key(rows: DataFrame, order: tuple[str, ...], keys: tuple[str, ...] = KEY) -> DataFrame:
    """The last row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def puts(ops: DataFrame) -> DataFrame:
    return ops.where(F.col("tag") != DEL)


def tombstones(ops: DataFrame) -> DataFrame:
    """ns, key, last_del (seq) and n_dels of every key that was ever deleted."""
    return ops.where(F.col("tag") == DEL).groupBy(*KEY).agg(
        F.max("seq").alias("last_del"), F.count("*").alias("n_dels")
    )


def live(now_ms: int) -> Column:
    return (F.col("expires_at") == 0) | (F.col("expires_at") > now_ms)


def lww(ops: DataFrame, mode: str = "merge", honour_tombstones: bool = True) -> DataFrame:
    """One version per key, expired ones included."""
    if mode == "local":
        return top_per_key(ops, BY_LOG).where(F.col("tag") != DEL).select(*STATE)
    winners = top_per_key(puts(ops), BY_CLOCK)
    if honour_tombstones:
        winners = winners.join(tombstones(ops), list(KEY), "left_anti")
    return winners.select(*STATE)


def register_versions(ops: DataFrame, mode: str = "local") -> DataFrame:
    """All retained versions: puts after the key's last tombstone in log order; in merge mode none
    of a key that has a tombstone."""
    if mode == "merge":
        return puts(ops).join(tombstones(ops), list(KEY), "left_anti").select(*STATE)
    last = ops.where(F.col("tag") == DEL).groupBy(*KEY).agg(F.max(F.struct(*BY_LOG)).alias("_del"))
    kept = puts(ops).join(last, list(KEY), "left").where("_del is null or struct(seq, pos) > _del")
    return kept.select(*STATE)


def visible(versions: DataFrame) -> DataFrame:
    """The version that reads of a register key return."""
    return top_per_key(versions, BY_CLOCK)


def state(ops: DataFrame, now_ms: int | None, policy: str = "lww", mode: str = "merge") -> DataFrame:
    """The readable state, one row per key; now_ms None ignores expiry."""
    alive = live(now_ms) if now_ms is not None else F.lit(True)
    if policy == "lww":
        return lww(ops, mode).where(alive)
    return visible(register_versions(ops, mode).where(alive))


def state_by_policy(ops: DataFrame, namespaces: DataFrame, now_ms: int | None, mode: str = "merge") -> DataFrame:
    """The state of namespaces of both policies; `namespaces` is a small dimension table."""
    named = ops.join(namespaces.select("ns", "policy"), "ns")
    parts = [state(named.where(F.col("policy") == p).drop("policy"), now_ms, p, mode) for p in ("lww", "register")]
    return parts[0].unionByName(parts[1])


def expired(ops: DataFrame, now_ms: int) -> DataFrame:
    """Winners that reads hide because they are past their time."""
    return lww(ops, honour_tombstones=False).where(~live(now_ms))


def conflicts(versions: DataFrame) -> DataFrame:
    """Keys with more than one retained version."""
    return (
        versions.groupBy(*KEY)
        .agg(F.count("*").alias("n_versions"), F.countDistinct("replica").alias("distinct_replicas"))
        .where("n_versions > 1")
    )


def conflict_versions(versions: DataFrame) -> DataFrame:
    """The versions of conflicting keys in order of arrival, as arrays at the edge of the API."""
    item = F.struct("seq", "pos", "hlc", "replica", "expires_at", "value")
    return (
        versions.groupBy(*KEY).agg(F.sort_array(F.collect_list(item)).alias("versions")).where(F.size("versions") > 1)
    )


def next_prefix(prefix: bytes) -> bytes | None:
    """The least byte string after all that start with prefix; None if there is none."""
    body = prefix.rstrip(b"\xff")
    return body[:-1] + bytes([body[-1] + 1]) if body else None


def has_prefix(key: str, prefix: bytes | str) -> Column:
    """A prefix test that reaches the Parquet scan: StartsWith on text, range bounds on bytes."""
    c = F.col(key)
    if isinstance(prefix, str):
        return c.startswith(prefix)
    upper = next_prefix(prefix)
    low = c >= F.lit(prefix)
    return low if upper is None else low & (c < F.lit(upper))


def scan(rows: DataFrame, prefix: bytes | str, key: str = "key") -> DataFrame:
    """Rows under a prefix; put it on the log, before the fold, so that it prunes the scan."""
    return rows.where(has_prefix(key, prefix))
