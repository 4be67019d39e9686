"""Replication as set operations on logs: verify, select, deduplicate, append, fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import numbered

#: What makes two records the same. The clock alone is not enough: one clock may carry many keys.
IDENTITY = ("ns", "tag", "hlc", "replica", "key")
MOST_AHEAD = 64_000


def deduplicated(log: DataFrame, identity: tuple[str, ...] = IDENTITY) -> DataFrame:
    """The first arrival of every record."""
    w = Window.partitionBy(*identity).orderBy("seq")
    return log.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def missing(peer: DataFrame, local: DataFrame, identity: tuple[str, ...] = IDENTITY) -> DataFrame:
    """Records of a peer that the local log lacks, over the whole logs."""
    return peer.join(local.select(*identity), list(identity), "left_anti").select(*peer.columns)


def new_records(local: DataFrame, peer: DataFrame, identity: tuple[str, ...] = IDENTITY) -> DataFrame:
    """The records that the local log lacks, once each, in the peer's order and numbered on from the
    local head. Numbering is spread over tasks (see `shared.numbered`)."""
    new = numbered(deduplicated(missing(peer, local, identity), identity), ["ns"], ["seq"], "_place")
    head = local.groupBy("ns").agg(F.max("seq").alias("_head"))
    return new.join(head, "ns", "left").withColumn("seq", F.coalesce("_head", F.lit(0)) + F.col("_place")).select(*local.columns)


def apply_synced(local: DataFrame, peer: DataFrame, identity: tuple[str, ...] = IDENTITY) -> DataFrame:
    """The local log with the missing records appended."""
    return local.unionByName(new_records(local, peer, identity))


def sync_plan(local_heads: DataFrame, peer_heads: DataFrame, ahead: int = MOST_AHEAD) -> DataFrame:
    """Namespaces to pull: hosted here and longer there; how far a pull goes at once."""
    p = peer_heads.select("ns", F.col("head").alias("peer_head"))
    return (
        local_heads.join(p, "ns")
        .where("peer_head > head")
        .select("ns", (F.col("head") + 1).alias("first"), F.least("peer_head", F.col("head") + ahead).alias("target"))
    )


def allowed(records: DataFrame, allow: DataFrame) -> DataFrame:
    """Records of the (replica, ns) pairs on an allow-list."""
    return records.join(allow.select("replica", "ns").distinct(), ["replica", "ns"], "left_semi")


def pull_chunk(log: DataFrame, first: int, most: int = 1000, most_bytes: int = 960 << 10) -> DataFrame:
    """A prefix of at most `most` records and `most_bytes` bytes; one record always goes."""
    rows = log.where(F.col("seq") >= first).orderBy("seq").limit(most)
    w = Window.partitionBy("ns").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    size = F.octet_length("key") + F.octet_length("value")
    return rows.withColumn("_sum", F.sum(size).over(w)).withColumn("_n", F.row_number().over(Window.partitionBy("ns").orderBy("seq"))).where(
        (F.col("_sum") <= most_bytes) | (F.col("_n") == 1)
    ).drop("_sum", "_n")


def policy_mismatch(a: DataFrame, b: DataFrame) -> DataFrame:
    """Namespaces that two nodes would fold differently; merging those is refused."""
    return a.alias("a").join(b.alias("b"), "ns").where("a.policy <> b.policy").select("ns")


def _with_before(records: DataFrame) -> DataFrame:
    """Adds _before, the hash of the record before: an equi join on its number, spread by record."""
    before = records.select("ns", (F.col("seq") + 1).alias("seq"), F.col("hash").alias("_before"))
    return records.join(before, ["ns", "seq"], "left")


def chain_breaks(records: DataFrame) -> DataFrame:
    """Records whose `prev` is not the hash of the record before; the first of a batch is exempt."""
    return _with_before(records).where("_before is not null and prev <> _before").select(*records.columns)


def gaps(records: DataFrame) -> DataFrame:
    """ns of batches whose numbers are not consecutive."""
    return records.groupBy("ns").agg(F.count("*").alias("n"), (F.max("seq") - F.min("seq") + 1).alias("span")).where("n <> span").select("ns")


def verified_batches(records: DataFrame) -> DataFrame:
    """ns, ok: whether a batch of records (prev, hash, bytes) is sound as a whole."""
    own = F.unhex(F.sha2(F.concat("prev", "bytes"), 256)) == F.col("hash")
    ok = own & (F.col("_before").isNull() | (F.col("prev") == F.col("_before")))
    checked = _with_before(records).groupBy("ns").agg(F.bool_and(ok).alias("ok"))
    return checked.join(gaps(records).withColumn("gap", F.lit(True)), "ns", "left").select("ns", (F.col("ok") & F.col("gap").isNull()).alias("ok"))
