"""Tables in the folder that driver and executors share, and numbering along a global order."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that may be broadcast (16 MB of ids); beyond, joins are left to shuffle.
MOST_BROADCAST = 1_000_000


def root(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where that is unset, a temporary folder if the master is
    local; on a cluster there is no folder that all machines see, so that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tidefold.shared.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tidefold-')}"
        spark.conf.set("tidefold.shared.dir", base)
    path = spark._jvm.org.apache.hadoop.fs.Path(base)  # with its scheme, for readers other than Spark
    path = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return uri(path).rstrip("/")


def uri(path: str) -> str:
    """A qualified path of Spark's with the slashes that other readers want."""
    return re.sub("^file:/(?!/)", "file:///", path)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{root(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """`cut`, with the folder that the rows are in."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: the lineage ends there, each
    executor can read it, and a lost executor costs only a re-read."""
    return stored(df, name)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small_side(rows: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """Rows of a few numbers or a short text, with a broadcast hint if they are few by count."""
    return F.broadcast(rows) if rows.count() <= most else rows


def numbered(rows: DataFrame, within: list[str], order: list[str], place: str = "place") -> DataFrame:
    """Adds the place of each row (from 1) within its `within` columns, in the order of `order`.

    The rows are range-partitioned by both, so that a group of any size is spread over tasks, and
    written; counts per group and partition are summed up along the partitions, and rows are only
    ordered inside their partition. Rows that are equal in all these columns may swap places."""
    keys = [*within, *order]
    ranged = cut(rows.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy(*within, "_part").agg(F.count("*").alias("_n"))
    along = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(within)], F.col("_part").alias("_p"),
        F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_ahead"),
    )
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(within):
        same &= F.col(c).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy("_part", *within).orderBy(*order)
    return ranged.join(ahead, same).withColumn(place, F.col("_ahead") + F.row_number().over(inside)).select(*rows.columns, place)
