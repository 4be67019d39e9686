import numpy as np
import pytest

from tidefold.llm import hnsw

SF = "/root/testdata/sf0.01"


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute(rows, k=5, every=50):
    data = {(i, tuple(v)) for i, v in rows if i is not None and usable(v)}
    out = {}
    for q, a in data:
        if q % every:
            continue
        best = []
        for i, b in data:
            if i != q and len(a) == len(b):
                x, y = np.array(a, float), np.array(b, float)
                best.append((-float((x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum()))), i))
        out[q] = [(i, -s) for s, i in sorted(best)[:k]]
    return out


def found(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


@pytest.mark.parametrize("shard_size", [8192, 120])
def test_recall_on_whole_table(spark, shard_size):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in e.collect()])
    got = found(hnsw.nearest(e, shard_size=shard_size))
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (5 * len(want)) >= 0.95
    for q, near in got.items():
        assert near == sorted(near, key=lambda x: (-x[1], x[0]))


def test_recall_with_clusters(spark):
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(40, 24)), 75, axis=0) + 0.05 * rng.normal(size=(3000, 24))
    rows = [(i, [float(np.float32(a)) for a in v]) for i, v in enumerate(x)]
    got = found(hnsw.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")))
    unit = np.array([v for _, v in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    hits = 0
    for q, near in got.items():
        s = unit @ unit[q]
        s[q] = -2
        hits += len({i for i, _ in near} & set(np.argsort(-s)[:5].tolist()))
    assert hits / (5 * len(got)) >= 0.9


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(i, v, "x") for i in range(1, 40)] + [(0, v, "x"), (0, v, "x"), (50, [2.0, 4.0, 6.0], "x"), (100, None, "x"), (150, [0.0, 0.0, 0.0], "x"),
            (200, [1.0, None, 2.0], "x"), (250, [float("nan"), 1.0, 1.0], "x"), (300, [float("inf"), 1.0, 1.0], "x"), (350, [], "x"),
            (400, [1.0, 0.0], "x"), (450, [0.0, -1.0, 0.0], "x"), (None, v, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string")
    got, want = found(hnsw.nearest(df)), brute([(i, x) for i, x, _ in rows])
    assert 400 in want and not want[400]
    want.pop(400)
    assert got.keys() == want.keys()
    for q in want:
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]])
    assert [i for i, _ in got[0]] == [i for i, _ in want[0]]
    assert found(hnsw.nearest(df.limit(0))) == {}
