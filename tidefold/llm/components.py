"""Connected components of a link table by alternating large-star and small-star steps.

Both steps only group by a node and join the least neighbour back, so links stay distributed, those of
the hub of a large group too; each step is written to the shared folder, which ends its lineage, and
what was before it is deleted.
Star-shaped links settle in two or three rounds, and any graph in a number of rounds that grows with the
logarithm of its diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, spread_join, stored


def _large_star(links: DataFrame) -> tuple[DataFrame, str]:
    """The new links, and the folder of the least neighbours, which they read."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least, path = stored(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least")
    near = least.select("a", F.least("a", "m").alias("m"))
    out = spread_join(both.where("b > a"), near, ["a"], "b", least.select("a", "n"))
    return out.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), path


def _small_star(links: DataFrame) -> tuple[DataFrame, str]:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least, path = stored(down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least")
    moved = spread_join(down, least.select("a", "m"), ["a"], "b", least.select("a", "n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.select("a", F.col("m").alias("b")).union(moved.where("a <> b")).distinct(), path


def _state(links: DataFrame) -> tuple:
    r = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for every node of the links (a, b), a <> b."""
    links, path = stored(links.where("a <> b").distinct(), "links")
    state = _state(links)
    while state[0]:
        old = [path]
        for step in (_large_star, _small_star):
            made, least = step(links)
            links, path = stored(made, "links")
            old += [least, path]
        for gone in old[:-1]:
            discard(links.sparkSession, gone)
        before, state = state, _state(links)
        if state == before:
            break
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
