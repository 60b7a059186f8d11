"""The stages on the small corpus, each against a plain version of its decision."""

import re

import pytest

import corpus_pipeline
from test_token_groups import brute
from trackspark.llm import cgk, secrets, toxicity
from trackspark.session import cut_lineage

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, f in corpus_pipeline.STAGES:
        docs = cut_lineage(f(spark, docs, SF), name)
        out.append(docs)
    return out


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_columns(stages):
    assert all(s.columns == stages[0].columns and s.dtypes == stages[0].dtypes for s in stages[:-1])


def test_toxicity(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = toxicity.score_toxicity(stages[0], labels).filter("predicted = 0")
    assert ids(stages[1]) == ids(scored)


def test_near_copies(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[1].collect()]
    assert ids(stages[2]) == {d for d, _, c in brute(rows, 5, 80) if d == c}


def test_leaks(spark, stages):
    items = [" ".join(r["text"].split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = {r["doc_id"] for r in stages[2].collect() if any(i in " ".join(r["text"].split()) for i in items)}
    assert gone <= ids(stages[2]) - ids(stages[3])
    assert ids(stages[2]) - ids(stages[3]) == ids(cgk.leaks(stages[2], spark.read.parquet(f"{SF}/benchmark.parquet")))


def test_secrets(stages):
    before = {r["doc_id"]: r["text"] for r in stages[3].collect()}
    after = {r["doc_id"]: r for r in stages[4].collect()}
    assert set(before) == set(after)
    for d, text in before.items():
        assert not secrets.base_spans(after[d]["text"]) and after[d]["n_chars"] == len(after[d]["text"])
        if not secrets.base_spans(text) and not re.search(r"\S{20}", text):
            assert after[d]["text"] == text


def test_packing(stages):
    assert ids(stages[5]) == ids(stages[4])
    assert stages[5].groupBy("sequence_id").agg({"length": "sum"}).filter("`sum(length)` > 4096").count() == 0
