import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidefold.llm import attribution
from tidefold.llm.tokens import tokenizer_path

SF = "/root/testdata/sf0.01"
PATH = tokenizer_path("byte_bpe_50k.tiktoken")


def sections_of(text):
    first = text.find("\n") + 1 or len(text)
    tail = max(first, len(text) - len(text.rsplit("\n", 1)[-1]))
    return [("head", 0, first), ("body", first, tail), ("tail", tail, len(text))]


def brute(text, sections, rule):
    """Byte by byte: the owner of each byte, then one vote per token."""
    e = attribution.ByteEncoder.shared(PATH)
    ids = e.encoding.encode_ordinary(text)
    owner = [None] * len(text.encode())
    for i, (_, a, b) in enumerate(sections):
        for k in range(len(text[:a].encode()), len(text[:b].encode())):
            owner[k] = i
    at, n, cross = 0, {}, {}
    for t in ids:
        own = owner[at : at + len(e.encoding.decode_single_token_bytes(t))]
        at += len(own)
        pick = {"start": own[0], "end": own[-1]}.get(rule) if rule != "majority" else max(
            set(own), key=lambda s: (own.count(s), -(s if s is not None else 99)))
        n[pick] = n.get(pick, 0) + 1
        cross[pick] = cross.get(pick, 0) + (len(set(own)) > 1 if rule == "majority" else own[0] != own[-1])
    assert at == len(owner)
    return n, cross, len(ids)


@pytest.mark.parametrize("rule", attribution.RULES)
def test_whole_table_matches_brute_force(spark, rule):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {}
    for r in attribution.token_counts(docs, rule=rule).collect():
        got.setdefault(r.doc_id, {})[r.section] = (r.n_chars, r.n_tokens, r.n_crossing, r.doc_tokens)
    for r in docs.where("text is not null").collect():
        parts = sections_of(r.text)
        n, cross, total = brute(r.text, parts, rule)
        assert got[r.doc_id] == {name: (b - a, n.get(i, 0), cross.get(i, 0), total) for i, (name, a, b) in enumerate(parts)}


@given(st.text(st.sampled_from("aé \n日the"), max_size=25), st.lists(st.integers(0, 25), min_size=2, max_size=6))
@settings(max_examples=200, deadline=None)
def test_any_sections(text, cuts):
    cuts = sorted(min(c, len(text)) for c in cuts)
    parts = [(str(i), a, b) for i, (a, b) in enumerate(zip(cuts[::2], cuts[1::2], strict=False))]
    ends = attribution.ByteEncoder.shared(PATH).ends(text)
    at = np.array([[len(text[:a].encode()), len(text[:b].encode())] for _, a, b in parts]).reshape(-1, 2)
    for rule in attribution.RULES:
        section, _ = attribution.allocate(ends, at[:, 0], at[:, 1], rule)
        n, _, _ = brute(text, parts, rule)
        assert {None if s < 0 else int(s): int(k) for s, k in zip(*np.unique(section, return_counts=True), strict=True)} == n


def test_odd_rows(spark):
    data = [(1, None, 1), (2, "", 1), (3, "no line end", 1), (4, "\n", 1), (5, "a\nb", 1), (5, "a\nb", 1), (None, "x\ny\nz", 1), (6, "é\n" * 30000, 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, sections int")
    rows = attribution.token_counts(docs).collect()
    assert len(rows) == 3 * 7
    assert sum(r.n_tokens for r in rows if r.doc_id == 2) == 0
    for r in rows:
        if r.doc_id == 6 and r.section == "body":
            assert r.n_chars == 2 * 29999
    assert attribution.token_counts(docs.limit(0)).count() == 0
    own = attribution.token_counts(docs.where("doc_id = 3"), F.expr("array(named_struct('name', 'part', 'start', 3L, 'end', 99L))")).collect()
    assert {r.section: r.n_chars for r in own} == {"part": 8, None: 3}
