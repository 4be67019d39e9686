import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidefold.llm import neardup
from tidefold.llm import superminhash as smh
from tidefold.llm.components import components
from tidefold.llm.textvec import mix

SF = "/root/testdata/sf0.01"
LOWER = {i: i + 32 for i in range(65, 91)}
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k, percent=80):
    """Sets and components by comparing every two texts."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, s) in enumerate(sets):
        for j, u in sets[:n]:
            if None in (i, j) or not s or not u or 100 * min(len(s), len(u)) < percent * max(len(s), len(u)):
                continue
            both = len(s & u)
            if 100 * both >= percent * (len(s) + len(u) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


@pytest.mark.parametrize("k", [2, 5])
def test_whole_table_matches_brute_force(spark, k):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = neardup.near_duplicates(docs, k).collect()
    want = brute([(r.doc_id, r.text) for r in docs.collect()], k)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_chains_and_odd_rows(spark):
    words = [f"w{i}" for i in range(60)]
    chain = [" ".join(words[i : i + 50]) for i in range(0, 10, 2)]  # neighbours are alike, the ends are not
    texts = [*chain, chain[0].upper(), None, "", " \n", "one", "ONE", "two words", "two  WORDS", "other words", "z " * 60000, "z " * 500]
    data = [(i, t, "x") for i, t in enumerate(texts)]
    data += [(None, chain[0], "x"), (None, None, "x"), (3, "one", "x"), (40, "fresh text here", "x"), (40, "fresh text here", "x")]
    docs = spark.createDataFrame(data, "doc_id long, text string, node string")
    got = neardup.near_duplicates(docs, 2).collect()
    want = brute([(i, t) for i, t, _ in data], 2)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want
    assert all(r.kept for r in got if r.doc_id is None)
    assert neardup.near_duplicates(docs.limit(0), 2).count() == 0
    left = neardup.filter_documents(docs, 2)
    assert left.columns == docs.columns
    assert left.where("doc_id is not null").select("doc_id").distinct().count() == len({c for _, _, c in want if c is not None})


def test_large_group_of_near_copies(spark):
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for i in range(300):
        own = list(base)
        for p in rng.choice(120, 4, replace=False):
            own[p] = f"x{i}-{p}"
        texts.append(" ".join(own))
    data = list(enumerate(texts))
    got = neardup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), 2).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(data, 2)


def test_one_id_in_several_classes_is_one_node(spark):
    data = [(1, "a b c d"), (5, "a b c d"), (2, "x y z w"), (5, "x y z w"), (7, "p q r s"), (7, "k l m n"), (8, "k l m n"), (5, ""), (9, "")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs, 2).collect())
    assert got == [(1, 3, 1, True), (2, 3, 1, False), (5, 0, 5, True), (5, 3, 1, False), (5, 3, 1, False), (7, 3, 7, True), (7, 3, 7, True), (8, 3, 7, False), (9, 0, 9, True)]
    left = sorted((r.doc_id, r.text) for r in neardup.filter_documents(docs, 2).collect() if r.text)
    assert len(left) == 2 and left[0] == (1, "a b c d") and left[1][0] == 7


def test_repeated_rows_and_null_ids_leave_one_row(spark):
    words = [f"w{i}" for i in range(40)]
    text, near, other = " ".join(words), " ".join(words[:-1]), "some quite different words here"
    data = [(3, text, "a"), (3, text, "b"), (3, text, "b"), (None, text, "c"), (None, near, "d"), (None, other, "e"), (None, other, "f"), (None, None, "g"),
            (None, "", "h"), (4, None, "i"), (4, " ", "j"), (4, None, "i"), (6, "one of a kind of text", "k"), (6, "another text of the same id", "l")]
    docs = spark.createDataFrame(data, "doc_id long, text string, _gone string")
    left = neardup.filter_documents(docs.repartition(3))
    assert left.columns == docs.columns
    rows = sorted(map(tuple, left.collect()), key=str)
    full = [r for r in rows if (r[1] or "").strip()]
    assert [r for r in rows if not (r[1] or "").strip()] == sorted([r for r in data if not (r[1] or "").strip()], key=str)
    assert len(full) == 3 and {r[0] for r in full} == {3, 6, None} and {r[1] for r in full} >= {text, other}
    assert sorted(map(tuple, neardup.filter_documents(docs.repartition(5)).collect()), key=str) == rows


def template_pages(n, own, seed=5):
    """Texts with a common template; `own` of 100 shingles are a text's own."""
    rng = np.random.default_rng(seed)
    common = [f"t{i}" for i in range(100 - own)]
    return [(i, " ".join(common + [f"u{i}-{j}" for j in range(own)])) for i in rng.permutation(n).tolist()]


def test_template_pages_below_the_limit_are_not_paired(spark):
    """2,000 texts that share buckets at a similarity of 0.7; 40 of them have a partner."""
    data = template_pages(2000, 17)
    texts = dict(data)
    for i in range(40):
        texts[i] = " ".join([*texts[i + 100].split()[:-1], f"last{i}"])
    data = sorted(texts.items())
    docs = spark.createDataFrame(data, "doc_id long, text string")
    sk = neardup.cut(neardup.sketches(docs, 2, neardup.BANDS, neardup.ROWS), "t-sk")
    assert sk.select(F.explode("keys").alias("key")).groupBy("key").count().agg(F.max("count")).first()[0] > 500
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, 2).collect()}
    assert got == {i: i - 100 if 100 <= i < 140 else i for i, _ in data}
    sets = neardup.cut(neardup._sets_of(docs, docs.select(F.col("doc_id").alias("node")), 2), "t-sets")
    rows = neardup.prefixes(sets, neardup.shingle_counts(sets), 80)
    pairs = rows.alias("x").join(rows.alias("y"), "key").where("x.node < y.node and (x.leads or y.leads)")
    assert pairs.count() < 20 * len(data)


def test_prefix_filter_loses_no_link(spark):
    """Every bucket takes the way of the large ones, with blocks of a few members."""
    rng = np.random.default_rng(8)
    data = []
    for g in range(30):
        base = [f"g{g % 10}-{i}" for i in range(60)]
        for _ in range(8):
            own = list(base)
            for p in rng.choice(60, rng.integers(0, 9), replace=False):
                own[p] = f"x{rng.integers(0, 10**6)}"
            data.append((len(data), " ".join(own[: rng.integers(45, 61)])))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    sk = neardup.cut(neardup.sketches(docs, 2, neardup.BANDS, neardup.ROWS), "t-sk")
    sets = neardup.cut(neardup._sets_of(docs, docs.select(F.col("doc_id").alias("node")), 2), "t-sets")
    heavy = sk.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("component"), F.col("n_shingles").alias("n"), "parity")
    small, neardup.BLOCK = neardup.BLOCK, 7
    try:
        rarest = neardup.prefixes(sets, neardup.shingle_counts(sets), 80).drop("n").join(heavy.select("node", "component"), "node")
        got = {(r.a, r.b) for r in neardup._meet(rarest, heavy.select("node", "n", "parity"), 80).collect()}
    finally:
        neardup.BLOCK = small
    plain = {i: shingles(t, 2) for i, t in data}
    want = {(i, j) for i in plain for j in plain if i < j and 100 * len(plain[i] & plain[j]) >= 80 * len(plain[i] | plain[j])}
    same = {(i, j) for i, j in want if plain[i] == plain[j]}
    assert len(want) > 100 and want - same <= got


def plain(elements, m):
    sig = [0xFFFFFFFF] * m
    for e in elements:
        p = list(range(m))
        for j in range(m):
            d = int(mix(np.array([(e + (j + 1) * int(smh.STEP)) % 2**64], np.uint64))[0])
            k = j + ((d >> 32) * (m - j) >> 32)
            p[j], p[k] = p[k], p[j]
            sig[p[j]] = min(sig[p[j]], (j << 24) + (d & 0xFFFFFF))
    return sig


@pytest.mark.parametrize("n", [0, 1, 2, 9, 60])
def test_signatures_equal_the_plain_algorithm(n):
    e = np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64)
    assert smh.signatures(e, np.zeros(n, np.int64), 1, 24)[0].tolist() == plain([int(x) for x in e], 24)


def test_components_of_paths_and_cycles(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, 3), (3, 9), (9, 5), (200, 5)] + [(1000, 1000 + i) for i in range(1, 50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 100 for i in range(100, 161)} | dict.fromkeys((3, 5, 9, 200), 3) | {1000 + i: 1000 for i in range(50)}
    assert got == want
