import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidefold.llm import packing
from tidefold.llm.tokens import WordEncoder, tokenizer_path

SF = "/root/testdata/sf0.01"
PATH = tokenizer_path("word_bpe_49k.json")


def whole(pieces, lengths):
    got = defaultdict(list)
    for doc, at, n in pieces:
        got[doc].append((at, n))
    for doc, length in enumerate(lengths):
        at = 0
        for a, n in sorted(got[doc]):
            assert a == at and n > 0
            at += n
        assert at == length


@given(st.lists(st.integers(1, 9000), max_size=60))
@settings(max_examples=150, deadline=None)
def test_plan_keeps_every_token_and_pads_nothing(lengths):
    out = packing.plan(lengths)
    whole([p for _, q in out for p in q], lengths)
    for tier, pieces in out:
        assert sum(n for *_, n in pieces) == tier and tier & (tier - 1) == 0 and tier <= 2048


def test_step_groups_are_even():
    sizes = [t for t, _ in packing.plan([(i * 37) % 3000 + 1 for i in range(900)])]
    total = Counter()
    for g, n in zip(packing.step_groups(sizes, 1 << 16), sizes, strict=True):
        total[g] += n
    assert len(total) > 5 and max(total.values()) - min(total.values()) <= 4096


def check(spark, docs):
    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = True
    rows = packing.pack(docs).collect()
    ids = {}
    for r in docs.collect():
        e = plain.encode(r.text or "", add_special_tokens=False).ids + [1]
        ids.setdefault(r.doc_id, []).append(np.array(e, "<u4"))
    seen = Counter()
    for r in rows:
        n = r.start + r.length
        assert any(
            len(e) == r.doc_tokens and zlib.crc32(e[r.start : n].tobytes()) == r.ids_crc32 for e in ids[r.doc_id]
        )
        seen[r.doc_id] += r.length
    assert seen == {k: sum(map(len, v)) for k, v in ids.items()}
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for q in by.values():
        at = 0
        for offset, n in sorted(q):
            assert offset == at
            at += n
        assert at <= 2048 and at & (at - 1) == 0
    return rows


def test_whole_table(spark):
    assert check(spark, spark.read.parquet(f"{SF}/documents.parquet"))


def test_odd_rows(spark):
    data = [(1, None, 3), (2, "", 3), (3, "word " * 30000, 3), (None, "x", 3), (4, "same", 3), (4, "same", 3),
            (5, "l'été ÇA!? x́ İ ǅ <|endoftext|> 12 b\x1cc don't", 3), (6, "a" * 20000, 3)]
    df = spark.createDataFrame(data, "doc_id long, text string, length int")
    check(spark, df)
    assert packing.pack(df.limit(0)).count() == 0


@given(st.text(st.sampled_from("aZéß'sStTlL,.!*0٣ \n\t\x1c\x85́ǅİªº×<|>"), max_size=30))
@settings(max_examples=300, deadline=None)
def test_encoder_equals_the_tokenizer(text):
    e = WordEncoder.shared(PATH)
    want = e.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(e.encode(text), "<u4").tolist() == want


@pytest.mark.parametrize("most", [1, 3])
def test_small_memories_change_nothing(most):
    e = WordEncoder(PATH, most=most, most_words=most)
    text = "The cat, the dog; the cat! été, l'été. " * 5
    assert np.frombuffer(e.encode(text), "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_long_runs_are_not_remembered():
    e = WordEncoder(PATH)
    text = " ".join(["x" * 400_000, "y" * 65 + ".", "!" * 300, "short"])
    assert np.frombuffer(e.encode(text), "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids
    assert max(map(len, [*e, *e.words])) <= e.LONGEST and "short" in e


def test_step_groups_span_partitions_and_flushes(spark):
    docs = spark.range(1200).selectExpr("id as doc_id", "repeat('word ', 10 + cast(id * 37 % 700 as int)) as text").repartition(6)
    rows = packing.pack(docs, shard_tokens=20_000, group_tokens=1 << 14).collect()
    sizes = {r.sequence_id: r.tier for r in rows}
    groups = {r.sequence_id: r.step_group for r in rows}
    assert all(groups[r.sequence_id] == r.step_group for r in rows)
    total = Counter()
    for i, g in groups.items():
        total[g] += sizes[i]
    n = round(sum(total.values()) / (1 << 14))
    assert len({i >> 40 for i in sizes}) == 6 and n > 12
    assert sorted(total) == list(range(n)) and max(total.values()) - min(total.values()) <= 4096
    order = sorted(sizes)
    assert [groups[i] for i in order] == packing.step_groups([sizes[i] for i in order], 1 << 14)
