import duckdb
import pytest
from pyspark.sql import functions as F

from tidefold.llm import mixing

SF = "/root/testdata/sf0.01"


def brute(rows, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets by repeated resharing; rows of (source, size)."""
    sizes = {}
    for s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    budget, capped = share * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = budget - sum(most * sizes[s] for s in capped)
        level = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if weight[s] * level > most * sizes[s]]
        if not over:
            return sizes, {s: most * sizes[s] if s in capped else weight[s] * level for s in order}
        capped |= set(over)


def check(df):
    rows = mixing.schedule(df, slot_documents=50).collect()
    sizes, goal = brute([(r.source, r.size) for r in rows])
    budget = int(1.5 * sum(sizes.values()))
    assert sum(r.taken for r in rows) == min(budget, 2 * sum(sizes.values()))
    packets = []  # in one global order, up to the budget
    for n, r in enumerate(rows):
        if r.size:
            end = round(r.virtual_finish * r.target)
            packets += [((end + lap * r.source_size) / r.target, r.source is None, r.source or "", end + lap * r.source_size, n) for lap in (0, 1)]
    want, left = [0] * len(rows), budget
    for *_, n in sorted(packets):
        part = min(left, rows[n].size)
        want[n] += part
        left -= part
    assert want == [r.taken for r in rows]
    taken, largest = {}, max((r.size for r in rows), default=0)
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(goal[r.source], rel=1e-9, abs=1e-9)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, n in taken.items():
        assert abs(n - goal[s]) <= largest + 1
    return rows


def test_matches_sql_and_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = check(docs)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = sorted(con.sql(f"select doc_id, source, size, source_size, target, taken from ({mixing.ORACLE_SQL})").fetchall())
    assert sorted((r.doc_id, r.source, r.size, r.source_size, r.target, r.taken) for r in rows) == want
    again = mixing.schedule(docs.repartition(7), slot_documents=50).collect()
    assert sorted(again) == sorted(rows)


def test_sql_counts_words_by_the_same_spaces(spark, tmp_path):
    texts = ["a\rb\x0bc", "a\x0c\x1cb \x85 c", " \t\n", "one\u2003two three", None, "x y z\rw"] * 40
    docs = spark.createDataFrame([(i, t, f"s{i % 4}" if i % 5 else None) for i, t in enumerate(texts)], "doc_id long, text string, source string")
    rows = check(docs)
    docs.coalesce(1).write.parquet(f"{tmp_path}/d")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    want = con.sql(f"select doc_id, source, size, source_size, target, taken from ({mixing.ORACLE_SQL})").fetchall()
    assert sorted(((r.doc_id, r.source, r.size, r.source_size, r.target, r.taken) for r in rows), key=str) == sorted(want, key=str)
    assert {r.doc_id: r.size for r in rows}[0] == 3


def test_many_copies_of_one_row(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 7)
    monkeypatch.setattr(mixing, "FEW", 5)
    monkeypatch.setattr(mixing, "SLICES", 3)
    data = [(1, "same words here", "a")] * 100 + [(i, "w " * (i % 9), "ab"[i % 2]) for i in range(2, 150)] + [(None, "x y", None)] * 9
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    rows = check(docs)
    assert len(rows) == len(data)
    assert sorted(mixing.schedule(docs.repartition(5), slot_documents=9).collect(), key=str) == sorted(rows, key=str)


def test_materialised_mix_follows_the_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("place", F.lit("clash")).withColumn("k", F.lit(1))
    mix = mixing.materialise(docs, slot_documents=50)
    assert mix.columns == docs.columns
    n = {r.source: (r.n, r.most) for r in mix.groupBy("source").agg(
        F.sum(mixing.size_of(F.col("text"))).alias("n"), F.max(mixing.size_of(F.col("text"))).alias("most")).collect()}
    _, goal = brute([(r.source, r.size) for r in docs.select("source", mixing.size_of(F.col("text")).alias("size")).collect()])
    assert all(abs(n[s][0] - goal[s]) <= n[s][1] for s in goal)
    assert mix.groupBy("doc_id").count().agg(F.max("count")).first()[0] == 2


def test_odd_rows(spark):
    data = [(1, None, "a"), (2, "", "a"), (3, "x y", None), (4, "x y", None), (4, "x y", None), (None, "p q r", "b"),
            (5, "w " * 50000, "c"), (6, "\x0b\x0c\x1c", "d"), (7, None, "e")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    rows = check(df)
    assert len(rows) == len(data)
    assert mixing.schedule(df.limit(0)).count() == 0 and mixing.materialise(df.limit(0)).count() == 0
    assert all(r.taken == 0 for r in mixing.schedule(df.where("size(split(text,'x')) is null or doc_id in (2, 7)")).collect())
