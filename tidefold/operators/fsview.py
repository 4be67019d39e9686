"""Keys as a tree of files: listings, lookups, and writes as new log operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fold


def readdir(state: DataFrame, folder: str = "", path: str = "path") -> DataFrame:
    """name, is_dir, n_files of the entries of a folder. A name that is both a file and a folder is
    what its last key in order says. Empty names, `.`, `..` and names with NUL are skipped."""
    prefix = f"{folder.strip('/')}/" if folder.strip("/") else ""
    rest = F.substring(F.col(path), len(prefix) + 1, 1 << 30)
    rows = fold.scan(state, prefix, path).select(F.col(path).alias("p"), rest.alias("rest"))
    entry = rows.withColumn("name", F.substring_index("rest", "/", 1)).withColumn("is_dir", F.instr("rest", "/") > 0)
    named = entry.where("name not in ('', '.', '..')").where(F.instr("name", "\0") == 0)
    return named.groupBy("name").agg(F.max_by("is_dir", "p").alias("is_dir"), F.count("*").alias("n_files"))


def attributes(state: DataFrame, column: str = "path") -> DataFrame:
    """path, size and mtime (seconds) of every file."""
    return state.select(
        F.col(column).alias("path"), F.octet_length("value").alias("size"), (F.shiftright("hlc", 16) / 1000).alias("mtime")
    )


def getattr_(state: DataFrame, path: str, column: str = "path") -> DataFrame:
    """size and mtime of a file; empty if there is none."""
    return attributes(state.where(F.col(column) == path), column).drop("path")


def dir_exists(state: DataFrame, folder: str, column: str = "path") -> bool:
    return not fold.scan(state, f"{folder.strip('/')}/", column).limit(1).isEmpty()


def read_range(value: Column, offset: int, size: int) -> Column:
    return F.substring(value, offset + 1, size)


def padded(value: Column, size: int) -> Column:
    """Truncation, with zero bytes where the file grows."""
    return F.when(F.octet_length(value) >= size, F.substring(value, 1, size)).otherwise(
        F.rpad(value.cast("binary"), size, F.lit(b"\0"))
    )


def _operation(spark: SparkSession, ns: str, tag: int, key: bytes, hlc: int, replica: bytes, value: bytes = b"", expires_at: int = 0) -> DataFrame:
    row = (ns, tag, key, hlc, replica, replica, value, expires_at)
    return spark.createDataFrame([row], "ns string, tag int, key binary, hlc long, replica binary, author binary, value binary, expires_at long")


def made_dir(spark: SparkSession, ns: str, folder: str, hlc: int, replica: bytes) -> DataFrame:
    """A marker, so that a folder without files is seen: an empty value under the folder's name."""
    return _operation(spark, ns, 1, f"{folder.strip('/')}/".encode(), hlc, replica)


def created(spark: SparkSession, ns: str, path: str, hlc: int, replica: bytes) -> DataFrame:
    """An empty file."""
    return _operation(spark, ns, 1, path.strip("/").encode(), hlc, replica)


def unlinked(spark: SparkSession, ns: str, path: str, hlc: int, replica: bytes) -> DataFrame:
    """A tombstone for one file; nothing under a folder of that name is touched."""
    return _operation(spark, ns, 2, path.strip("/").encode(), hlc, replica)


def written(old: Column, data: Column, offset: int | None = None) -> Column:
    """A file's bytes after a write at offset (None: at its end), with zero bytes in a gap."""
    old = F.coalesce(old.cast("binary"), F.lit(b""))
    if offset is None:
        return F.concat(old, data)
    rest = F.substring(old, F.lit(offset + 1) + F.octet_length(data), F.lit(1 << 30))
    return F.concat(padded(old, offset), data, rest)


def removed(state: DataFrame, folder: str, hlc: int, replica: bytes, column: str = "key") -> DataFrame:
    """Tombstones for everything under a folder, with a clock of its own for each key."""
    rows = fold.scan(state, f"{folder.strip('/')}/".encode(), column)
    return rows.select(
        "ns", F.lit(2).alias("tag"), "key", _clock(hlc).alias("hlc"), F.lit(replica).alias("replica"),
        F.lit(replica).alias("author"), F.lit(b"").alias("value"), F.lit(0).cast("long").alias("expires_at"),
    )


def renamed(state: DataFrame, old: str, new: str, hlc: int, replica: bytes) -> DataFrame:
    """Puts under the new folder (expiry travels) and tombstones under the old one."""
    a, b = f"{old.strip('/')}/".encode(), f"{new.strip('/')}/".encode()
    rows = fold.scan(state, a)
    moved = rows.select(
        "ns", F.when(F.col("expires_at") == 0, 1).otherwise(3).alias("tag"),
        F.concat(F.lit(b), F.substring("key", len(a) + 1, 1 << 30)).alias("key"), _clock(hlc).alias("hlc"),
        F.lit(replica).alias("replica"), F.lit(replica).alias("author"), "value", "expires_at",
    )
    return moved.unionByName(removed(state, old, hlc, replica))


def _clock(hlc: int) -> Column:
    """Clocks of one write: the low bits tell the keys apart for peers that compare clocks only."""
    return F.lit(hlc).cast("long") + F.pmod(F.xxhash64("key"), F.lit(65536)).cast("long")


def rewritten(old: DataFrame, new: DataFrame, now_ms: int) -> DataFrame:
    """New contents keep an unexpired expiry of the file they replace."""
    kept = old.where(F.col("expires_at") > now_ms).select("ns", "key", F.col("expires_at").alias("_keep"))
    return new.join(kept, ["ns", "key"], "left").withColumn("expires_at", F.coalesce("_keep", F.lit(0).cast("long"))).drop("_keep")
