"""The pipeline's stages against brute force on the smallest tables."""

import pytest

import corpus_pipeline
from marketlens.llm import toxicity
from tests.llm.test_documents import lowered
from tests.llm.test_ngram_join import grams

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.saved(stage(spark, docs, SF), "test-stage")
        out.append(docs)
    return out


def test_columns(steps):
    assert all(s.columns == steps[0].columns for s in steps[1:-1])
    assert set(steps[-1].columns) >= {"doc_id", "start", "length", "tokens"}


def test_decisions(spark, steps):
    rows = [[tuple(r) for r in s.collect()] for s in steps]
    first, clean, good, single, apart, packed = rows
    model = toxicity.fit(steps[0], spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r.doc_id: r.score for r in toxicity.score(steps[0], model).collect()}
    assert sorted(clean) == sorted(r for r in first if scores[r[0]] < 0.3)
    assert set(good) <= set(clean)
    last = {}
    for r in good:
        last[lowered(r[1])] = max(r[0], last.get(lowered(r[1]), -1))
    assert sorted(r[0] for r in single) == sorted(last.values())
    sets = {r[0]: grams(r[1]) for r in single}
    kept = {r[0] for r in apart}
    top = {d: d for d in sets}

    def root(d):
        while top[d] != d:
            d = top[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and len(sets[a] & sets[b]) * 5 >= len(sets[a] | sets[b]) * 4:
                x, y = sorted((root(a), root(b)))
                top[y] = x
    assert kept == {root(d) for d in ids}
    assert {r[0] for r in packed} == kept


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.saved(stage(spark, docs, SF), "test-stage")
        assert docs.count() == 0
