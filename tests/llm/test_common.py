from pyspark.sql import functions as F

from tidefold.llm import common


def test_hot_keys_are_dealt_in_portions(spark):
    """10,000 rows of one key, a few of others and one of none, against the plain join."""
    rows = spark.range(10_000).select(F.lit(7).alias("key"), F.col("id").alias("by"))
    rows = rows.union(spark.createDataFrame([(1, 1), (2, 2), (2, 3), (None, 4)], "key int, by long"))
    side = spark.createDataFrame([(7, "hot"), (1, "one"), (3, "three")], "key int, v string")
    counts = rows.groupBy("key").agg(F.count("*").alias("n"))
    for how in ("inner", "left"):
        got = common.spread_join(rows, side, ["key"], "by", counts, how)
        assert sorted(got.columns) == ["by", "key", "v"]
        plain = rows.join(side, "key", how).select(*got.columns)
        assert got.count() == plain.count() and got.exceptAll(plain).isEmpty()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        got = common.spread_join(rows, side, ["key"], "by", counts).withColumn("part", F.spark_partition_id())
        assert got.where("key = 7").select("part").distinct().count() > 1
        few = counts.withColumn("n", F.lit(1).cast("long"))
        assert common.spread_join(rows, side, ["key"], "by", few).count() == 10_001
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert common.spread_join(rows.limit(0), side, ["key"], "by", counts.limit(0)).isEmpty()
