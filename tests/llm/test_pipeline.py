from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from tidefold.llm import mixing, quality
from tidefold.llm.common import cut, table

from .test_neardup import brute
from .test_packing import check

SF = "/root/testdata/sf0.01"


def test_stages_in_order(spark):
    docs = table(spark, SF, "documents")
    model = quality.fit(docs, table(spark, SF, "labels"))
    verdicts = {r.doc_id: r.kept for r in quality.judge(docs, model).collect()}
    kept = cut(corpus_pipeline.STAGES[0][1](spark, docs, SF), "t")
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, k in verdicts.items() if k}

    single = cut(corpus_pipeline.STAGES[1][1](spark, kept, SF), "t")
    assert single.columns == docs.columns
    groups = brute([(r.doc_id, r.text) for r in kept.collect()], 5)
    assert sorted(r.doc_id for r in single.collect()) == sorted(i for i, _, c in groups if i == c)

    mix = cut(corpus_pipeline.STAGES[2][1](spark, single, SF), "t")
    assert mix.columns == docs.columns
    size = mixing.size_of(F.col("text"))
    words = [df.agg(F.sum(size)).first()[0] for df in (single, mix)]
    assert abs(words[1] - 1.5 * words[0]) < 0.02 * words[0]

    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "mixing", "packing"]
    assert check(spark, mix)
    assert corpus_pipeline.run(spark, SF).count() > 0


OWN_NAMES = ("key", "node", "component", "own", "row", "again", "has_word", "size", "slot", "shard", "kept", "portion")


def test_odd_rows_and_clashing_names_in_each_stage(spark):
    prose = " ".join(f"word{i}" for i in range(60))
    long = " ".join(f"term{i * i % 9973} of{i % 7}" for i in range(40_000))
    data = [(1, None, None), (2, "", "a"), (None, prose, None), (3, prose, "a"), (3, prose, "a"), (4, long, "b"), (5, " \n\t", "b"), (None, None, "a")]
    docs = cut(spark.createDataFrame(data, "doc_id long, text string, source string").withColumns({c: F.lit(7) for c in OWN_NAMES}), "t")
    quality_rules, near_duplicates, mix_sources, pack_sequences = (stage for _, stage in corpus_pipeline.STAGES)

    def texts(df):
        assert df.columns == docs.columns
        return sorted((r.text for r in df.collect()), key=str)

    judged = quality.judge(docs, quality.fit(docs, table(spark, SF, "labels")))
    kept = Counter(r.doc_id for r in judged.where("kept").collect())
    assert Counter(r.doc_id for r in quality_rules(spark, docs, SF).collect()) == kept
    assert set(kept) <= {None, 3, 4}

    assert texts(near_duplicates(spark, docs, SF)) == sorted([None, None, "", " \n\t", prose, long], key=str)
    copies = Counter(texts(mix_sources(spark, docs, SF)))
    assert set(copies) <= {t for _, t, _ in data} and copies[prose] <= 6 and copies[long] <= 2
    assert sum(r.length for r in check(spark, docs)) > 80_000

    for stage in (quality_rules, near_duplicates, mix_sources):
        assert texts(stage(spark, docs.limit(0), SF)) == []
    assert pack_sequences(spark, docs.limit(0), SF).count() == 0
