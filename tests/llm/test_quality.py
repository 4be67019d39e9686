import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidefold.llm import quality
from tidefold.llm import textvec as tv

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    ws = WORD.findall(text or "")
    windows = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(8)}
    dup, seen = 0, set()
    for line in (text or "").split("\n"):
        dup += line in seen and bool(WORD.search(line))
        seen.add(line)
    counts = (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered))
    return counts + (counts[0] < 20 or 100 * counts[4] > 30 * counts[0],)


@pytest.fixture(scope="module")
def model(spark):
    return quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))


def rows(df):
    return [
        (r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed), r.kept)
        for r in df.collect()
    ]


def test_counts_match_brute_force(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id: brute(r.text) for r in docs.collect()}
    got = rows(quality.judge(docs, model))
    assert len(got) == len(want)
    assert all(want[i] == c and not (c[-1] and kept) for i, c, kept in got)


def test_held_out_accuracy(spark, model):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = [(labels[i], kept) for i, c, kept in rows(quality.judge(docs, model)) if i in labels and not c[-1]]
    assert sum(bool(q) == k for q, k in got) / len(got) > 0.97


def test_odd_rows(spark, model):
    w8 = "a b c d e f g h"
    texts = [None, "", " \t\n", "é" * 5, f"{w8} {w8} {w8}", f"x {w8}\n{w8} y\n{w8} y\n", "long " * 60000,
             "a\x0bb\x0cc\x1cd e", "same\nsame\n\n\nsame", "word" * 500000, "## | <b>"]
    data = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "null id", "x"), (1, "repeat", "x"), (1, "repeat", "x")]
    docs = spark.createDataFrame(data, "doc_id long, text string, kept string")
    got = sorted(rows(quality.judge(docs, model)), key=str)
    want = sorted([(i, brute(t)) for i, t, _ in data], key=str)
    assert [(i, c) for i, c, _ in got] == want


def test_training_and_scoring_see_the_same_features(spark, model):
    texts = ["a b c d e", "été où ça\nñandú 日本語 текст 🙂🙂 x", "", "x", "word " * 300, None, "日本語テキスト " * 400_000, "é", "abcé"]
    batch = pa.RecordBatch.from_pydict({"text": texts, "quality": [1] * len(texts), "h": [0] * len(texts)})
    trained = [np.frombuffer(a, np.int32) for a in quality._features(batch, 16).column("ids").to_pylist()]
    shares = [np.frombuffer(a, np.float32) for a in quality._features(batch, 16).column("shares").to_pylist()]
    want = [float(model.weights[i] @ s.astype(float)) + model.bias for i, s in zip(trained, shares, strict=True)]
    got = []
    for s in tv.slices(batch.column("text")):
        w = tv.words(s)
        got += quality._margins(s, w, tv.hash_spans(s.data, w.starts, w.ends), model, 16).tolist()
    assert got == pytest.approx(want, rel=1e-4, abs=1e-4)


def test_character_grams_are_of_code_points():
    texts = ["été où", "日本語テキスト", "a🙂b🙂c", "plain ascii", "x", ""]
    for s in tv.slices(pa.array(texts)):
        c, bounds = quality._characters(s)
        assert np.diff(bounds).tolist() == [len(t) for t in texts]
        names = {}
        for t, a in zip(texts, bounds, strict=False):
            for i, x in enumerate(t):
                assert names.setdefault(x, c[a + i]) == c[a + i]
        assert len(set(names.values())) == len(names)


def test_sample_is_bounded_and_taken_after_the_join(spark):
    n = 400
    docs = spark.createDataFrame([(i, f"good text {i}" if i % 4 else f"bad text {i}") for i in range(n)] + [(1, "good text 1")] * 500, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(-5000, n)] + [(2, 0), (None, 1)], "doc_id long, quality int")
    for most in (40, 150, 1000):
        sample, found = quality.labelled_sample(docs, labels, most)
        rows = sample.collect()
        assert found == {0: 100, 1: n - 101}
        assert len(rows) == min(most, n - 1) == len({r.text for r in rows})
        assert sum(r.quality == 0 for r in rows) == min(most // 2, 100)
        assert all(r.quality == r.text.startswith("good") for r in rows)
    assert quality.fit(docs, labels, 40).fitted


def test_few_labels_still_fit(spark):
    docs = spark.createDataFrame([(1, "nice words of good prose"), (2, "### $$$ %%% ###"), (3, "more nice words")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert model.fitted and model.slope > 0
    q = {r.doc_id: r.quality for r in quality.judge(docs, model).collect()}
    assert q[1] > q[2] < q[3]
    assert not quality.fit(docs, labels.where("quality = 1")).fitted


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert not model.fitted and quality.judge(docs, model).count() == 0
    one = spark.createDataFrame([(1, " ".join(map(str, range(30))))], "doc_id long, text string")
    assert quality.judge(one, model).first().kept
    assert quality.filter_documents(one, model).count() == 1
