"""Binary snapshots of a store, for those who come with existing data; new checkpoints are Parquet.

File index.snap: 8 bytes of magic, whose end IDX1 or IDX2 tells the version; revision (u64); metadata,
a count (u32) and pairs of byte strings; peer clocks, a count and (name, i64); namespaces, a count and for
each: name, policy (u8: 0 lww, 1 register), head seq (u64), head hash (32), entries and tombstones. An entry
is a key, a kind (u8) and one version (kind 0) or a count and that many (kind 1); a version is hlc (u64),
replica (32), author (32), value, seq (u64) and, in version 2, expires_at (u64). A tombstone is a key and its
hlc (u64). Byte strings carry their length (u32) in front. All numbers are little-endian.

The format can only be read from its beginning, so a task reads a file; it streams the file and hands rows
on in batches of bounded bytes. Files of several stores are read in parallel. A file without any bytes is
no snapshot, as Spark's listing leaves it out.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ops
from ..schema import DEL, PUT, PUT_TTL
from ..shared import uri
from .binlog import HELD, Corrupt, read_log

#: The bytes of the two policies.
POLICIES = ("lww", "register")
ROWS = (
    "ns string, policy string, head bigint, head_hash binary, seq bigint, pos int, tag int, key binary, hlc bigint, replica binary, "
    "author binary, value binary, expires_at bigint"
)
COLUMNS = [c.split()[0] for c in ROWS.split(", ")]


def entries(source: BinaryIO) -> Iterator[dict]:
    """The rows of a snapshot in the order of the file. Each namespace begins with a row without a tag that
    holds its policy and head; peer clocks are rows without a policy whose hlc is the difference. A
    tombstone takes the head as its seq, so that it hides what the snapshot holds of its key and a later
    put of the log is after it."""

    def take(n: int) -> bytes:
        got = source.read(n)
        if len(got) != n:
            raise Corrupt("snapshot is cut off")
        return got

    def number(code: str) -> int:
        return struct.unpack(f"<{code}", take(struct.calcsize(code)))[0]

    def text() -> bytes:
        return take(number("I"))

    magic = take(8)
    if magic[4:] not in (b"IDX1", b"IDX2"):
        raise Corrupt("not a snapshot")
    expires = magic[4:] == b"IDX2"

    def version(key: bytes) -> dict:
        r = {"key": key, "hlc": number("Q"), "replica": take(32), "author": take(32), "value": text(), "seq": number("Q")}
        r["expires_at"] = number("Q") if expires else 0
        return r | {"tag": PUT_TTL if r["expires_at"] else PUT}

    number("Q")
    for _ in range(number("I")):
        text(), text()
    for _ in range(number("I")):
        yield {"ns": text().decode(errors="replace"), "hlc": number("q")}
    for _ in range(number("I")):
        ns, policy = text().decode(errors="replace"), number("B")
        if policy >= len(POLICIES):
            raise Corrupt(f"policy {policy} of {ns}")
        head, own = number("Q"), take(32)
        yield {"ns": ns, "policy": POLICIES[policy], "head": head, "head_hash": own}
        common = {"ns": ns, "policy": POLICIES[policy], "head": head}
        for _ in range(number("I")):
            key, kind = text(), number("B")
            if kind > 1:
                raise Corrupt(f"entry of kind {kind} in {ns}")
            for _ in range(number("I") if kind else 1):
                yield common | version(key)
        for _ in range(number("I")):
            yield common | {"key": text(), "hlc": number("Q"), "tag": DEL, "seq": head, "value": b""}
    if source.read(1):
        raise Corrupt("bytes after the snapshot")


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows (see `entries`) of the snapshots under path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "index.snap").load(path).select("path")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blank = dict.fromkeys(COLUMNS) | dict.fromkeys(("head", "seq", "pos", "tag", "hlc", "expires_at"), 0)
        for pdf in frames:
            for file in pdf["path"]:
                store, at = fs.FileSystem.from_uri(uri(file))
                rows, size = [], 0
                with store.open_input_stream(at, buffer_size=1 << 20) as source:
                    for r in entries(source):
                        rows.append(blank | r)
                        size += len(r.get("value") or b"") + 500
                        if size >= HELD:
                            yield pd.DataFrame(rows, columns=COLUMNS)
                            rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=COLUMNS)

    return files.mapInPandas(read, ROWS)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The operations that snapshots retain (OPS), tombstones included."""
    return read_rows(spark, path).where("tag <> 0").select(*_OPS)


def read_heads(spark: SparkSession, path: str) -> DataFrame:
    """ns, policy, head, hash of the namespaces of snapshots."""
    return read_rows(spark, path).where("tag = 0 and policy is not null").select("ns", "policy", "head", F.lower(F.hex("head_hash")).alias("hash"))


def read_peer_clocks(spark: SparkSession, path: str) -> DataFrame:
    """peer, skew as recorded in snapshots."""
    return read_rows(spark, path).where("tag = 0 and policy is null").select(F.col("ns").alias("peer"), F.col("hlc").alias("skew"))


_OPS = ["ns", "seq", "pos", "tag", "key", "hlc", "replica", "author", "value", "expires_at"]


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """OPS of a store's folder: its snapshot and the records of its binary log after the snapshot's head, or
    the whole log of a namespace that the snapshot lacks."""
    heads = read_heads(spark, path).select("ns", "head")
    tail = read_log(spark, path).join(heads, "ns", "left").where("seq > coalesce(head, 0)").drop("head")
    return read_snapshot(spark, path).unionByName(ops.explode_batches(tail).select(*_OPS))
