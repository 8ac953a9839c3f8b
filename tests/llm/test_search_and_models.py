"""Operators 2, 3 and 6."""

import random

import numpy as np
import pytest

from meterlens.llm import decontamination, fm_index, importance, language_id

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("seed", range(40))
def test_index_finds_and_locates_every_occurrence(seed):
    rng = np.random.default_rng(seed)
    seq = rng.integers(1, rng.integers(2, 7), int(rng.integers(1, 150)))
    if seed % 3 == 0:
        seq = np.tile(seq[: max(1, len(seq) // 5)], 5)
    top = int(seq.max()) + 1
    index = fm_index.FmIndex(seq, top)
    lengths = rng.integers(1, 6, 30)
    phrases = rng.integers(1, top + 1, (30, 6))
    lo, hi = index.search(phrases, lengths)
    for k in range(30):
        want = phrases[k, : lengths[k]].tolist()
        at = [i for i in range(len(seq) - len(want) + 1) if seq[i : i + len(want)].tolist() == want]
        assert sorted(index.locate(np.arange(lo[k], hi[k])).tolist()) == at


def _brute(text, items, size=10):
    words = decontamination.item_words(text)
    hit, found = set(), set()
    for item, t in items:
        w = decontamination.item_words(t)
        for s in range(max(1, len(w) - size + 1)) if w else ():
            window = w[s : s + size]
            for i in range(len(words) - len(window) + 1):
                if words[i : i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("options", [{}, {"shard_words": 50, "block_windows": 20}])
def test_hits_match_brute_force(spark, options):
    rng = random.Random(2)
    items = [(i, " ".join(rng.choice("abcdé") for _ in range(rng.choice([0, 3, 9, 10, 14, 30])))) for i in range(25)] + [(99, None)]
    docs = [(None, None), (0, ""), (1, "...")]
    for d in range(2, 60):
        parts = [" ".join(rng.choice("abcdéxy") for _ in range(rng.randint(0, 40)))]
        parts += [rng.choice(items)[1] or "" for _ in range(rng.randint(0, 3))]
        rng.shuffle(parts)
        docs.append((d, rng.choice(["; ", " z ", "-"]).join(parts).upper()))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    text = dict(docs)
    rows = decontamination.benchmark_hits(spark, df, bench, **options).collect()
    assert len(rows) == len(docs)
    for r in rows:
        t = text[r.row.doc_id]
        n, hit, found = _brute(t, items)
        assert (r.n_words, sum(b - a for a, b in r.spans), r.items) == (n, hit, found)
        if t and r.spans:
            left = [w for i, w in enumerate(decontamination.item_words(t)) if not any(a <= i < b for a, b in r.spans)]
            assert decontamination.item_words(decontamination.without_spans(t, r.spans)) == left


def test_decontamination_of_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "FIVE six"), (1, "FIVE six"), (None, "second line"), (3, None)], "item_id long, text string")
    out = decontamination.decontaminated(spark, odd_docs, bench)
    assert out.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted("2 3 4 5 None None 6 8".split())
    assert decontamination.decontaminated(spark, odd_docs, bench.limit(0)).count() == 12
    assert decontamination.decontaminated(spark, no_docs, bench).count() == 0


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = language_id.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r.lang == r.lang_pred for r in rows if r.held_out]
    assert len(rows) == docs.count() and 0.1 < len(held) / len(rows) < 0.4
    assert sum(held) / len(held) >= 0.95 and all(0 <= r.score <= 1 for r in rows)


def test_predictions_do_not_see_the_label(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    model = language_id.trained(docs)
    texts = docs.limit(20).toArrow().column("text").combine_chunks()
    assert (model.predict(texts)[0] == model.predict(texts)[0]).all()
    unlabelled = docs.selectExpr("doc_id", "text", "if(crc32(cast(string(doc_id) as binary)) % 4 = 2, null, lang) AS lang")
    assert sorted(language_id.identified(docs).collect()) == sorted(language_id.identified(unlabelled).collect())


@pytest.mark.parametrize("k", [1, 2, 3, 4, 7, 8, 30])
def test_codewords_are_apart(k):
    words = language_id.codewords(k).astype(int)
    apart = [(words[i] != words[j]).sum() for i in range(k) for j in range(i)]
    assert len(words) == k and min(apart, default=9) >= {2: 1, 3: 2}.get(k, 4)


def test_ambiguous_texts_are_flagged(spark):
    one = [(i, "der die das und nicht ein ist", "de", "s") for i in range(40)] + [(i, "the and not one is of to", "en", "s") for i in range(40, 80)]
    df = spark.createDataFrame([*one, (100, "das und the and", None, "s"), (101, "zqzq", None, "s")], "doc_id long, text string, lang string, source string")
    rows = {r.doc_id: r for r in language_id.identified(df).collect()}
    assert rows[0].lang_pred == "de" and rows[50].lang_pred == "en" and not rows[0].ambiguous and rows[101].ambiguous


def test_languages_of_odd_rows(spark, odd_docs, no_docs):
    rows = language_id.identified(odd_docs).collect()
    assert len(rows) == 12 and {r.doc_id for r in rows if r.lang_pred == "und"} == {3, 4, 5, 8}
    assert all(r.score == 0 for r in rows if r.lang_pred == "und")
    assert language_id.identified(no_docs).count() == 0
    bare = language_id.identified(odd_docs.withColumn("lang", odd_docs["lang"].substr(9, 1)).filter("lang is null")).collect()
    assert {r.lang_pred for r in bare} <= {"und", ""}


def test_resampling_takes_the_largest_keys(spark):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    for share in (None, 0.0, 0.3, 1.0):
        rows = importance.resampled(spark, docs, labels, share).collect()
        own = share if share is not None else np.mean([r.quality for r in labels.collect()])
        k = int(len(rows) * own + 0.5)
        best = {r.doc_id for r in sorted(rows, key=lambda r: -r.key)[:k]}
        assert {r.doc_id for r in rows if r.selected} == best


def test_need_is_a_staged_row(spark, monkeypatch):
    seen = []
    cut = importance.order_cut
    monkeypatch.setattr(importance, "order_cut", lambda rows, need, *rest: seen.append(need) or cut(rows, need, *rest))
    docs = spark.createDataFrame([(k, f"word{k % 7} and more") for k in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(20)], "doc_id long, quality int, toxic int")
    assert sum(r.selected for r in importance.resampled(spark, docs, labels).collect()) == 25
    assert "Aggregate" not in seen[0]._jdf.queryExecution().optimizedPlan().toString() and seen[0].count() == 1


def test_log_weights_match_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    good = importance.good_ids(labels)
    ids = {r.doc_id for r in good.filter("good").collect()}
    import pyarrow as pa

    raw, target, own = np.ones(importance.BUCKETS), np.ones(importance.BUCKETS), {}
    for r in docs.collect():
        own[r.doc_id] = np.bincount(importance._features(pa.array([r.text]))[0], minlength=importance.BUCKETS)
        raw += own[r.doc_id]
        target += own[r.doc_id] * (r.doc_id in ids)
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    for r in importance.resampled(spark, docs, labels).collect():
        assert r.log_weight == pytest.approx(own[r.doc_id] @ ratio, abs=1e-6)


def test_resampling_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (6, 1, 0), (None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    rows = importance.resampled(spark, odd_docs, labels).collect()
    assert len(rows) == 12 and all(r.log_weight == 0 for r in rows if r.doc_id in (3, 4, 5))
    assert not any(r.selected for r in importance.resampled(spark, odd_docs, labels.limit(0)).collect())
    assert importance.resampled(spark, no_docs, labels).count() == 0
