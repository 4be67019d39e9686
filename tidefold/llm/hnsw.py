"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard.

Distinct vectors are dealt to shards of about `shard_size` by a hash; each shard's graph is built by
one task and stored as flat neighbour arrays (one row per shard, Parquet in the shared folder). The
queries go to the shared folder too. A shard stays in the task that reads it, and the queries pass it
in blocks; only the k hits of each query and shard are shuffled, and merged by score.

Building: a vector's level is drawn from its hash; on each level the candidates of a node are its
nearest nodes there (blocked matrix products inside the shard, whose size is bounded), thinned by the
diversity rule: a candidate stays if it is nearer to the node than to every neighbour chosen before.
Links run both ways. Searching: greedy beams from the top level down, all queries of a block at once,
with `ef` places on the ground level.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no
part, neither as queries nor as candidates; vectors of different lengths are never compared; rows
with a null id take no part; equal rows count once; equal vectors share one node, whose smallest
k + 1 ids are all that can appear in a result of k (ties go to the smaller id, and a query leaves
out its own id). A query with fewer than k candidates gets them all. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_batches, stored

SHARD = 8192
NEAR, UPPER, CANDIDATES = 24, 12, 48
BLOCK = 1024
#: Queries that search a shard together.
QUERY_BLOCK = 256

INDEX = "dim int, shard long, size long, vectors binary, ids binary, id_ends binary, levels array<struct<nodes:binary,ends:binary,links:binary>>"
FOUND = "query_id long, vec_id long, score double"


def valid_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, v (array<double>) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        embeddings.where("vec_id is not null and embedding is not null")
        .select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), finite.alias("ok"))
        .where("ok")
        .where(F.exists("v", lambda x: x != 0))
        .select("vec_id", "v")
    )


def _key(v: Column) -> list[Column]:
    return [F.xxhash64(v).alias("h1"), F.xxhash64(F.lit(7), v).alias("h2")]


def distinct_vectors(vectors: DataFrame, ids: int) -> DataFrame:
    """v and its `ids` smallest ids in order; a frequent vector is cut down before the shuffle."""
    keyed = vectors.select("vec_id", "v", *_key(F.col("v"))).distinct()
    first = Window.partitionBy("h1", "h2", "v").orderBy("vec_id")
    return (
        keyed.withColumn("rank", F.row_number().over(first))
        .where(F.col("rank") <= ids)
        .groupBy("h1", "h2", "v")
        .agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    )


def unit(x: np.ndarray) -> np.ndarray:
    return (x / np.abs(x).max(axis=1, keepdims=True)).astype(np.float64)


def _normal(x: np.ndarray) -> np.ndarray:
    x = unit(x)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _neighbours(x: np.ndarray, most: int) -> np.ndarray:
    """Thinned nearest neighbours (n x most, -1 where none) of unit vectors."""
    n = len(x)
    c = min(CANDIDATES, n - 1)
    out = np.full((n, most), -1, np.int32)
    for a in range(0, n if c > 0 else 0, BLOCK):
        b = min(n, a + BLOCK)
        rows = np.arange(b - a)
        sims = x[a:b] @ x.T
        sims[rows, np.arange(a, b)] = -np.inf
        near = np.argpartition(-sims, c - 1, axis=1)[:, :c]
        own = np.take_along_axis(sims, near, axis=1)
        order = np.argsort(-own, axis=1, kind="stable")
        near, own = np.take_along_axis(near, order, axis=1), np.take_along_axis(own, order, axis=1)
        among = np.matmul(x[near], x[near].transpose(0, 2, 1))
        chosen = np.zeros((b - a, c), bool)
        count = np.zeros(b - a, np.int64)
        for i in range(c):
            crowded = (np.where(chosen, among[:, i], -np.inf) >= own[:, i : i + 1]).any(axis=1)
            take = ~crowded & (count < most)
            chosen[:, i] = take
            out[a + rows[take], count[take]] = near[take, i]
            count += take
    return out


def _both_ways(links: np.ndarray, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Flat neighbour lists with reverse links; lists over `most` keep the nearest."""
    n, w = links.shape
    src = np.repeat(np.arange(n), w)
    dst = links.ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    a, b = np.concatenate([src, dst]), np.concatenate([dst, src])
    pair = np.unique(a.astype(np.int64) * n + b)
    a, b = pair // n, pair % n
    sims = np.einsum("ij,ij->i", x[a], x[b])
    order = np.lexsort((-sims, a))
    a, b = a[order], b[order]
    place = np.arange(len(a)) - np.searchsorted(a, np.arange(n))[a]
    keep = place < most
    a, b = a[keep], b[keep]
    return np.searchsorted(a, np.arange(1, n + 1), "left").astype(np.int32) if n else np.zeros(0, np.int32), b.astype(np.int32)


def build_shard(x: np.ndarray, level_of: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(nodes, ends, links) for each level from the ground up; links index into nodes."""
    unit_x = _normal(x)
    out = []
    for level in range(int(level_of.max()) + 1):
        nodes = np.flatnonzero(level_of >= level).astype(np.int32)
        most = NEAR if level == 0 else UPPER
        own = unit_x[nodes]
        ends, links = _both_ways(_neighbours(own, most), own, 2 * most)
        out.append((nodes, ends, links))
    return out


def _table(ends: np.ndarray, links: np.ndarray) -> np.ndarray:
    """Neighbour lists as a matrix filled up with -1."""
    n = len(ends)
    starts = np.concatenate([[0], ends[:-1]]) if n else ends
    width = max(1, int((ends - starts).max())) if n else 1
    out = np.full((n, width), -1, np.int32)
    rows = np.repeat(np.arange(n), ends - starts)
    out[rows, np.arange(len(links)) - starts[rows]] = links
    return out


def beam(q: np.ndarray, x: np.ndarray, table: np.ndarray, entries: np.ndarray, ef: int) -> np.ndarray:
    """For each query the up to ef nearest nodes found from its entries (-1 where none), best first."""
    n_q, n = len(q), len(x)
    ef = min(ef, n)
    ids = np.full((n_q, ef), -1, np.int64)
    sims = np.full((n_q, ef), -np.inf, np.float32)
    opened = np.ones((n_q, ef), bool)
    seen = np.zeros((n_q, n), bool)

    def merge(rows: np.ndarray, new: np.ndarray) -> None:
        ok = new >= 0
        ok &= ~seen[rows[:, None], np.where(ok, new, 0)]
        safe = np.where(ok, new, 0)
        s = np.einsum("qwd,qd->qw", x[safe], q[rows])
        s = np.where(ok, s, -np.inf).astype(np.float32)
        r, _ = np.nonzero(ok)
        seen[rows[r], new[ok]] = True
        all_ids = np.concatenate([ids[rows], np.where(ok, new, -1)], axis=1)
        all_sims = np.concatenate([sims[rows], s], axis=1)
        all_open = np.concatenate([opened[rows], ~ok], axis=1)
        top = np.argsort(-all_sims, axis=1, kind="stable")[:, :ef]
        ids[rows] = np.take_along_axis(all_ids, top, axis=1)
        sims[rows] = np.take_along_axis(all_sims, top, axis=1)
        opened[rows] = np.take_along_axis(all_open, top, axis=1)

    rows = np.arange(n_q)
    merge(rows, entries)
    while True:
        best = np.argmin(opened, axis=1)
        rows = np.flatnonzero(~opened[np.arange(n_q), best])
        if not len(rows):
            return ids
        at = best[rows]
        node = ids[rows, at]
        opened[rows, at] = True
        merge(rows, table[node])


def search_shard(q: np.ndarray, x: np.ndarray, levels: list, ef: int, starts: int = 8) -> np.ndarray:
    """Node numbers of the nearest found (queries x ef)."""
    unit_q, unit_x = _normal(q), _normal(x)
    entries = None
    for level in range(len(levels) - 1, -1, -1):
        nodes, ends, links = levels[level]
        if entries is None:  # the top level is small: begin at evenly chosen nodes of it
            some = np.linspace(0, len(nodes) - 1, min(len(nodes), 16)).astype(np.int64)
            entries = np.tile(some, (len(q), 1))
        else:
            place = np.full(len(x), -1, np.int64)
            place[nodes] = np.arange(len(nodes))
            entries = np.where(entries >= 0, place[np.maximum(entries, 0)], -1)
        got = beam(unit_q, unit_x[nodes], _table(ends, links), entries, ef if level == 0 else starts)
        entries = np.where(got >= 0, nodes[np.maximum(got, 0)], -1)
    return entries


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise cosine in double precision."""
    dot = (a * b).sum(axis=-1)
    return dot / (np.sqrt((a * a).sum(axis=-1)) * np.sqrt((b * b).sum(axis=-1)))


def build(embeddings: DataFrame, k: int = 5, shard_size: int = SHARD) -> DataFrame:
    """The index, one row per shard, stored in the shared folder. Every distinct vector is in it."""
    vectors = cut(distinct_vectors(valid_vectors(embeddings), k + 1), "ann-vectors")
    sizes = vectors.groupBy(F.size("v").alias("dim")).agg(
        F.greatest(F.lit(1), F.ceil(F.count("*") / shard_size)).cast("long").alias("shards")
    )
    sizes = cut(sizes, "ann-sizes")
    shards = max(1, sizes.agg(F.coalesce(F.sum("shards"), F.lit(1))).first()[0])
    dealt = (
        vectors.withColumn("dim", F.size("v"))
        .join(sizes, "dim")
        .select("dim", F.pmod("h1", "shards").alias("shard"), "h2", "v", "ids")
        .repartition(shards, "dim", "shard")  # by number: a task for each shard, however few bytes it has
    )

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("h2", kind="stable", ignore_index=True)
        pdf = pdf.iloc[np.argsort([i[0] for i in pdf["ids"]], kind="stable")]
        x = np.stack(pdf["v"].to_numpy())
        draw = (pdf["h2"].to_numpy().view(np.uint64) >> np.uint64(11)).astype(np.float64) / 2.0**53
        level = np.minimum(6, np.floor(-np.log(np.maximum(draw, 1e-12)) / np.log(UPPER))).astype(np.int64)
        ids = np.concatenate(pdf["ids"].to_numpy()).astype(np.int64)
        ends = np.cumsum([len(i) for i in pdf["ids"]]).astype(np.int64)
        levels = [{"nodes": a.tobytes(), "ends": b.tobytes(), "links": c.tobytes()} for a, b, c in build_shard(x, level)]
        return pd.DataFrame(
            [(key[0], key[1], len(x), x.tobytes(), ids.tobytes(), ends.tobytes(), levels)],
            columns=["dim", "shard", "size", "vectors", "ids", "id_ends", "levels"],
        )

    return cut(dealt.groupBy("dim", "shard").applyInPandas(one, INDEX), "ann-index")


def _blocks(path: str, rows: int) -> Iterator[tuple[np.ndarray, list]]:
    """query_id and vectors of a table in the shared folder, a few rows at a time."""
    store, at = pafs.FileSystem.from_uri(path)
    for name in sorted(f.path for f in store.get_file_info(pafs.FileSelector(at)) if f.path.endswith(".parquet")):
        with store.open_input_file(name) as file:
            for batch in pq.ParquetFile(file).iter_batches(rows, columns=["query_id", "v"]):
                yield batch.column("query_id").to_numpy(), batch.column("v").to_pylist()


def search(index: DataFrame, queries: DataFrame, k: int = 5, ef: int = 96, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each query (query_id, v)."""
    _, path = stored(queries.select("query_id", "v"), "ann-queries")
    base = path if "://" in path else f"file://{path}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (r for batch in batches for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
            x = np.frombuffer(r["vectors"], np.float64).reshape(r["size"], r["dim"])
            ids, ends = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["id_ends"], np.int64)
            starts = np.concatenate([[0], ends[:-1]])
            levels = [tuple(np.frombuffer(lv[n], np.int32) for n in ("nodes", "ends", "links")) for lv in r["levels"]]
            for names, vectors in _blocks(base, block):
                own = [i for i, v in enumerate(vectors) if len(v) == r["dim"]]
                if not own:
                    continue
                q = np.array([vectors[i] for i in own])
                got = search_shard(q, x, levels, ef)[:, : 2 * k + 2]
                score = cosine(q[:, None, :], x[np.maximum(got, 0)])
                out = []
                for i, query in enumerate(names[own].tolist()):
                    best = [
                        (-s, v)
                        for node, s in zip(got[i], score[i], strict=True)
                        if node >= 0
                        for v in ids[starts[node] : ends[node]].tolist()
                        if v != query
                    ]
                    out += [(query, v, -s) for s, v in sorted(best)[:k]]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

    found = map_batches(index, run, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.distinct()
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


def nearest(embeddings: DataFrame, every: int = 50, k: int = 5, ef: int = 96, shard_size: int = SHARD) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by `every`."""
    queries = (
        valid_vectors(embeddings)
        .where(F.col("vec_id") % every == 0)
        .select(F.col("vec_id").alias("query_id"), "v")
        .dropDuplicates(["query_id"])
    )
    return search(build(embeddings, k, shard_size), queries, k, ef)
