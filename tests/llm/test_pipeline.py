"""The pipeline, stage by stage, against what the operators say of the stage's own input."""

from collections import Counter

import pytest

import corpus_pipeline
from meterlens.llm import decontamination, minhash, mixing, packing, quality_rules
from meterlens.llm.common import read, staged

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark):
    docs, out = read(spark, SF_DIR, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = staged(spark, stage(spark, docs, SF_DIR), name.replace(" ", "-"))
        out.append((docs, after))
        docs = after
    return out


def test_columns(outputs):
    for before, after in outputs[:-1]:
        assert after.columns == before.columns and [f.dataType for f in after.schema] == [f.dataType for f in before.schema]


def test_quality_stage(spark, outputs):
    before, after = outputs[0]
    kept = {r.doc_id for r in quality_rules.quality_verdicts(spark, before).collect() if r.kept}
    assert {r.doc_id for r in after.collect()} == kept
    assert after.filter("n_chars != char_length(text)").count() == 0


def test_near_dedup_stage(spark, outputs):
    before, after = outputs[1]
    kept = Counter(r.doc_id for r in minhash.near_duplicates(spark, before).collect() if r.kept)
    assert Counter(r.doc_id for r in after.collect()) == kept
    assert after.join(before, before.columns).count() == after.count()


def test_decontamination_stage(spark, outputs):
    before, after = outputs[2]
    bench = read(spark, SF_DIR, "benchmark")
    clean = {r.row.doc_id for r in decontamination.benchmark_hits(spark, before, bench).collect() if not r.spans}
    assert {r.doc_id for r in after.collect()} == clean and len(clean) < before.count()


def test_mixing_stage(spark, outputs):
    before, after = outputs[3]
    times = Counter({r.doc_id: r.taken // r.size for r in mixing.mix(spark, before).collect() if r.taken})
    assert Counter(r.doc_id for r in after.collect()) == times


def test_packing_stage(outputs):
    before, after = outputs[4]
    starts = Counter(d for r in after.collect() for d, at in zip(r.seg_docs, r.seg_offsets, strict=True) if at == 0)
    assert starts == Counter(r.doc_id for r in before.collect())
    once = packing.packed(before.dropDuplicates(["doc_id"]))
    assert {(r.doc_id, r.text) for r in packing.unpacked(once).collect()} == {(r.doc_id, r.text) for r in before.collect()}


def test_run_gives_the_rows_of_the_last_stage(spark, outputs):
    mine = corpus_pipeline.run(spark, SF_DIR)
    assert mine.columns == outputs[-1][1].columns
    assert mine.agg({"n_tokens": "sum"}).first() == outputs[-1][1].agg({"n_tokens": "sum"}).first()


def test_stages_on_odd_rows(spark, odd_docs, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd_docs, no_docs):
            out = stage(spark, docs, SF_DIR)
            assert name == "packing" or out.columns == docs.columns
            assert out.count() >= 0
