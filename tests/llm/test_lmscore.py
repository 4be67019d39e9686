import base64
import math
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tidefold.llm import lmscore
from tidefold.llm.attribution import ByteEncoder

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
V = 50256


@pytest.fixture(scope="module")
def encode():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def brute(rows, targets, encode, alpha=4.0):
    """The same models with dictionaries of token pairs, one token at a time."""
    texts = [(i, encode(t or "")) for i, t in rows]
    pairs, ones, contexts = ([Counter(), Counter()] for _ in range(3))
    for i, ids in texts:
        for v, w in zip(["start", *ids], ids, strict=False):
            for m in (0, 1) if i in targets else (1,):
                pairs[m][v, w] += 1
                ones[m][w] += 1
                contexts[m][v] += 1
    totals = [sum(c.values()) for c in ones]
    out = []
    for i, ids in texts:
        loss = [0.0, 0.0]
        for m in (0, 1):
            for v, w in zip(["start", *ids], ids, strict=False):
                p = (ones[m][w] + alpha / V) / (totals[m] + alpha)
                p = (pairs[m][v, w] + alpha * p) / (contexts[m][v] + alpha)
                assert p <= 1
                loss[m] -= math.log(p)
        n = len(ids)
        out.append((i, n, *((loss[0] / n, loss[1] / n, (loss[0] - loss[1]) / n) if n else (None, None, None))))
    return out


def same(got, want):
    order = lambda r: (str(r[0]), r[1], round(r[2] or 0, 6), round(r[3] or 0, 6))
    got, want = sorted(map(tuple, got), key=order), sorted(want, key=order)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    for a, b in zip(got, want, strict=True):
        assert a[2:] == (None,) * 3 if b[2] is None else a[2:] == pytest.approx(b[2:], rel=1e-9, abs=1e-9)


def test_small_texts_match_brute_force(spark, encode):
    data = [(1, "the cat sat", "x"), (2, "the dog sät", "x"), (3, "###$$$%%%", "x"), (4, None, "x"), (5, "", "x"), (6, "a", "x"), (7, "the", "x"),
            (None, "the cat", "x"), (1, "another cat", "x"), (8, "ha" * 3000, "x"), (9, "the cat sat", "x"), (9, "the cat sat", "x"), (10, "<|endoftext|>", "x")]
    docs = spark.createDataFrame(data, "doc_id long, text string, is_target string")
    targets = spark.createDataFrame([(1,), (2,), (2,), (9,), (None,)], "doc_id long")
    for portion in (3, 1000):
        got = lmscore.score_documents(docs.repartition(3), targets, portion_tokens=portion).collect()
        same(got, brute([(i, t) for i, t, _ in data], {1, 2, 9}, encode))
    assert lmscore.score_documents(docs.limit(0), targets).count() == 0
    none = lmscore.score_documents(docs, targets.limit(0)).where("n_tokens > 0").first()
    assert none.target_loss == pytest.approx(math.log(V))


def test_whole_table_matches_brute_force(spark, encode):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 and toxic = 0").select("doc_id")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = lmscore.score_documents(docs, good, portion_tokens=100_000).collect()
    same(got, brute(rows, {r.doc_id for r in good.collect()}, encode))
    assert all(r.target_loss >= 0 and r.background_loss >= 0 for r in got if r.n_tokens)


def test_a_very_long_text_is_scored_in_blocks(spark, encode):
    data = [(1, " ".join(f"w{i * i % 977}" for i in range(40_000))), (2, "w1 w4")]
    tokens = lmscore.tokenise(spark.createDataFrame(data, "doc_id long, text string"))
    grams = lmscore.portion_grams(tokens, V)
    same(lmscore.score(tokens, grams, lmscore.fit(grams, V), block=1000).collect(), brute(data, set(), encode))


def test_probabilities_after_a_context_sum_to_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 5000")
    tokens = lmscore.tokenise(docs, spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1"))
    assert len(ByteEncoder.shared(PATH).length) == V
    grams = lmscore.portion_grams(tokens, V)
    model = lmscore.fit(grams, V)
    rows = model.counts.toPandas()
    assert rows["gram"].is_unique and len(rows) > 10_000
    for v in (V, int(np.argmax(model.contexts[1])), int(np.argmin(model.contexts[1])), 17):
        every = (v << lmscore.BITS) + np.arange(V)
        for i, c in enumerate(("target", "background")):
            known = dict(zip(rows["gram"], rows[c], strict=True))
            p = model.probability(i, every, np.array([known.get(g, 0) for g in every.tolist()]))
            assert p.sum() == pytest.approx(1) and 0 < p.min() and p.max() <= 1


def test_target_documents_score_lower(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r.doc_id: r.score for r in lmscore.score_documents(docs, labels.where("quality = 1 and toxic = 0")).collect()}
    quality = {r.doc_id: r.quality for r in labels.collect()}
    good, bad = ([rows[i] for i, q in quality.items() if q == v] for v in (1, 0))
    assert np.mean([g < b for g in good for b in bad]) > 0.85
