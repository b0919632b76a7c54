"""The pipeline against a plain version of every stage, and the registered queries."""

import random

import pytest
from compare import differences, duck
from llm_data import alike, copy_shingles, edge_docs, edge_rows, empty_docs, sentence

import corpus_pipeline
from swelter.llm import decontam, mixing, packing, quality_fm
from swelter.llm.queries import QUERIES, SQL

SMALLEST = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert len(corpus_pipeline.STAGES) == 5
    names = [f.__name__ for _, f in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "decontaminate", "mix", "pack"]


def test_each_stage_on_what_its_predecessor_kept(spark):
    docs = spark.read.parquet(f"{SMALLEST}/documents.parquet")
    columns = docs.columns
    stages = [f for _, f in corpus_pipeline.STAGES]
    good = stages[0](spark, docs, SMALLEST).cache()
    machine = quality_fm.fit_quality(docs, spark.read.parquet(f"{SMALLEST}/labels.parquet"))
    want = {x.doc_id for x in docs.collect() if machine.score(x.text, x.n_chars) >= quality_fm.THRESHOLD}
    assert good.columns == columns and {x.doc_id for x in good.collect()} == want

    single = stages[1](spark, good, SMALLEST).cache()
    rows = good.collect()
    sets, label = [copy_shingles(x.text) for x in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and alike(sets[i], sets[j]):
                label = [label[j] if x == label[i] else x for x in label]
    want = {min(r.doc_id for r, x in zip(rows, label) if x == c) for c in set(label)}
    assert single.columns == columns and {x.doc_id for x in single.collect()} == want

    clean = stages[2](spark, single, SMALLEST).cache()
    blocks = [decontam.Block.of([(x.item_id, x.text) for x in spark.read.parquet(f"{SMALLEST}/benchmark.parquet").collect()])]
    want = {x.doc_id for x in single.collect() if not decontam.matched_items(x.text, blocks)}
    assert clean.columns == columns and {x.doc_id for x in clean.collect()} == want

    mixed = stages[3](spark, clean, SMALLEST).cache()
    taken = {x.doc_id: x.taken for x in mixing.taken_words(clean).collect() if x.taken}
    got = {}
    for x in mixed.collect():
        got[x.doc_id] = got.get(x.doc_id, 0) + len(x.text.split())
    assert mixed.columns == columns and got == taken

    packed = stages[4](spark, mixed, SMALLEST).collect()
    tokens = sum(len(packing.token_ids(x.text)) for x in mixed.collect())
    assert sum(x.n_tokens for x in packed) == tokens


def test_pipeline_of_awkward_documents(spark):
    docs = edge_docs(spark)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SMALLEST).cache()
        assert docs.count() > 0
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_pipeline_of_nothing(spark):
    docs = empty_docs(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALLEST)
        assert docs.count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SMALLEST).count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_like_sql(spark, name):
    assert differences(QUERIES[name](spark, SMALLEST), duck(SMALLEST), SQL[name]) == []


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_samples_are_as_hoped():
    assert len(edge_rows()) > 50 and sentence(random.Random(1), 3).count(" ") == 2
