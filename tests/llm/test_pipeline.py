"""The pipeline against its stages' own decisions, and on awkward input."""

from __future__ import annotations

import collections

import corpus_pipeline
from tests.conftest import SF_SMALL
from tests.llm.test_llm_operators import brute_components
from patchtrace.llm.exact_dedup import normalise


def test_stages_take_effect_in_order(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "language_id", "exact_dedup", "ngram_join", "packing"]
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, kept[-1], SF_SMALL).collect(), docs.schema)
        assert now.columns == docs.columns
        kept.append(now)
    ids = [{r["doc_id"] for r in k.collect()} for k in kept]
    assert all(b <= a for a, b in zip(ids[:-1], ids[1:], strict=True)) and len(ids[1]) < len(ids[0])
    # exact: the longest, then smallest id, of each group of equal texts
    groups = collections.defaultdict(list)
    for r in kept[2].collect():
        groups[normalise(r["text"] or "")].append((-len(r["text"] or ""), r["doc_id"]))
    assert ids[3] == {min(g)[1] for g in groups.values()}
    # near: the smallest id of each group
    want = brute_components([(r["doc_id"], r["text"]) for r in kept[3].collect()])
    assert ids[4] == {i for i, _, c in want if i == c}
    packed = corpus_pipeline.run(spark, SF_SMALL).collect()
    assert {r["doc_id"] for r in packed} == ids[4]
    total = {r["doc_id"]: r["doc_tokens"] for r in packed}
    assert sum(r["length"] for r in packed) == sum(total.values())


def test_stages_on_empty_and_null_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", None, None, 0), (1, "", None, None, 0)], docs.schema)
    for df in (docs.where("false"), odd):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, df, SF_SMALL).columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, df, SF_SMALL).count() == df.count()
