import re

import pytest

from tidefold.llm import licenses

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute(text):
    ws = WORD.findall((text or "").translate(LOWER))
    places = []
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(ws) - len(p) + 1) if ws[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return (
        len(ws), len(places), min(starts, default=None), max(starts, default=None),
        ",".join(sorted({x for _, x in places})),
    )


def got(df):
    return [
        ((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels), r.labels, r.score)
        for r in licenses.digest(licenses.scan(df)).collect()
    ]


def test_whole_table_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted((r.doc_id, *brute(r.text)) for r in docs.collect())
    rows = got(docs)
    assert sorted(r[0] for r in rows) == want
    assert any(r[0][2] for r in rows)
    for base, labels, score in rows:
        assert set(base[5].split(",")) - {""} <= set(labels.split(","))
        assert 0 <= score <= 1 and (score > 0) == bool(labels)


def test_odd_rows(spark):
    texts = [None, "", "MIT-License/mit license.MIT\nLICENSE", "cc by cc by cc\tby", "xcc by", "cc byé", "mit licenses",
             "the gnu GENERAL public License apache license", "word " * 100000 + "cc by", "CC\x00BY", "É mit license"]
    data = [(i, t, 0) for i, t in enumerate(texts)] + [(None, "mit license", 0), (2, "mit license", 0), (2, "mit license", 0)]
    docs = spark.createDataFrame(data, "doc_id long, text string, n_words int")
    assert sorted((r[0] for r in got(docs)), key=str) == sorted(((i, *brute(t)) for i, t, _ in data), key=str)
    assert got(docs.limit(0)) == []


@pytest.mark.parametrize(
    ("text", "labels", "duty"),
    [
        ("MIT", {"mit"}, 0),
        ("GPL-2.0-only WITH Classpath-exception-2.0", {"gpl"}, 1),
        ("MIT OR GPL-3.0", {"mit", "gpl"}, 0),
        ("MIT AND GPL-3.0", {"mit", "gpl"}, 2),
        ("(LGPL-2.1 OR MIT) AND BSD-3-Clause", {"lgpl", "mit", "bsd"}, 0),
        ("MIT OR GPL-3.0 AND AGPL-3.0", {"mit", "gpl", "agpl"}, 0),
        ("Unknown-1.0", set(), 3),
    ],
)
def test_expressions(text, labels, duty):
    assert licenses.evaluate(licenses.postfix(text)) == (labels, duty)


@pytest.mark.parametrize("text", ["", "MIT OR", "OR MIT", "(MIT", "MIT)", "MIT GPL", "()", "MIT; GPL"])
def test_malformed(text):
    with pytest.raises(licenses.ExpressionError):
        licenses.postfix(text)


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("MIT. Copyright 2020", "MIT"), ("MIT;", "MIT"), ('MIT",', "MIT"), ("MIT */", "MIT"), ("GPL-2.0+ or later", "GPL-2.0+ or later"),
        ("MIT OR", "MIT"), ("MIT) x", "MIT"), ("(MIT OR GPL-3.0) see below", "(MIT OR GPL-3.0)"), ("MIT OR (GPL-3.0", "MIT"),
        ("Apache-2.0 AND MIT is the licence", "Apache-2.0 AND MIT"), ("(MIT", ""), ("* x", ""), ("", ""), ("OR MIT", ""), ("MIT and - x", "MIT"),
    ],
)
def test_longest_expression_of_a_line(line, want):
    assert licenses.leading(line) == want


def test_tags_before_prose_add_labels():
    for tail in (". Copyright 2020 by no one", '",', ";", " - see LICENSE", "\u00a0and more"):
        assert licenses.Scanner().scan(f"SPDX-License-Identifier: MIT{tail}")[3] == ["mit"]


def test_tags_add_labels():
    text = "x\n// SPDX-License-Identifier: Apache-2.0 OR MIT\nSPDX-License-Identifier: (MIT\nreleased under the mit license"
    n, matches, expressions, labels, duty, score = licenses.Scanner().scan(text)
    assert labels == ["apache", "mit"] and expressions == ["apache-2.0 mit or"] and duty == 0 and score > 0.9
    assert [m["word"] for m in matches] == [16]
