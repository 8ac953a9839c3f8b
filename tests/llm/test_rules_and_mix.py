"""Operators 1 and 8 on small tables."""

import random
from collections import Counter

from meterlens.llm import mixing, quality_rules


def test_repeat_words_and_base_figures(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 40))) for _ in range(60)] + ["a b c a b c\nx  y\nx  y\n\n# $|"]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    for row in quality_rules.quality_verdicts(spark, df).collect():
        w = texts[row.doc_id].split()
        seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in texts[row.doc_id].split("\n") if x.strip()]
        assert (row.n_words, row.word_chars, row.n_repeat_words) == (len(w), sum(map(len, w)), len(hit))
        assert row.n_dup_lines == len(lines) - len(set(lines))
        assert row.base_failed and not row.kept


def _prose(seed, n):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def test_frequent_lines_go_and_depleted_documents_are_rejected(spark):
    menu = "Home News   About 2024 " + _prose(0, 60)
    rows = [(i, menu.replace("2024", str(2000 + i)) + "\n" + _prose(i + 1, 200), "h") for i in range(12)]
    rows += [(i, menu + "\n" + _prose(i + 1, 20), "h") for i in range(12, 15)]  # depleted
    rows += [(i, menu + "\n" + _prose(99, 20), "other") for i in range(15, 18)]  # rare on its host
    copy = _prose(77, 100)
    rows += [(i, copy, "h") for i in range(18, 40)]  # copies of one text are one document
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality_rules.quality_verdicts(spark, df).collect()}
    assert all(got[i].kept and got[i].removed_words == 64 for i in range(12))
    assert all(not got[i].kept and not got[i].base_failed for i in range(12, 15))
    assert all(got[i].kept and got[i].removed_words == 0 for i in range(15, 40))
    left = {r.doc_id: r for r in quality_rules.quality_filter(spark, df).collect()}
    assert set(left) == {*range(12), *range(15, 40)}
    assert left[3].text == rows[3][1].split("\n")[1] and left[20].text == copy


def test_odd_rows(spark, odd_docs, no_docs):
    rows = quality_rules.quality_verdicts(spark, odd_docs).collect()
    assert len(rows) == 12
    assert [r.kept for r in rows if r.doc_id == 6] == [True]
    kept = quality_rules.quality_filter(spark, odd_docs)
    assert kept.columns == odd_docs.columns and [r.doc_id for r in kept.collect()] == [6]
    assert quality_rules.quality_verdicts(spark, no_docs).count() == 0
    assert quality_rules.quality_filter(spark, no_docs).count() == 0


def _filled(sizes, weights, times=3):
    """Targets by rounds: clamp what is above, share the rest again."""
    left, open_, target = sum(sizes.values()), set(sizes), {}
    while True:
        level = left / sum(weights[s] for s in open_) if open_ else 0
        above = {s for s in open_ if weights[s] * level >= times * sizes[s]}
        if not above:
            return target | {s: weights[s] * level for s in open_}
        target |= {s: times * sizes[s] for s in above}
        left -= sum(target[s] for s in above)
        open_ -= above


def test_targets_and_amounts_taken(spark):
    rng = random.Random(5)
    share = {"a": 400, "b": 3, "c": 30, "d": 150, "é": 8, None: 60}
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), s) for s, n in share.items() for i in range(n)]
    rows = [(k, t, s) for k, (_, t, s) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    names = sorted((s for s in sizes if s is not None)) + [None]
    expected = _filled(sizes, {s: 1 + k % 3 for k, s in enumerate(names)})
    source = {k: s for k, _, s in rows}
    taken = Counter()
    first = mixing.mix(spark, df).collect()
    for r in first:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - expected[s]) < 1e-6 * expected[s]
        assert r.size == 0 == r.taken or (r.taken % r.size == 0 and r.taken <= 3 * r.size)
        taken[s] += r.taken
    assert all(abs(taken[s] - expected[s]) <= 20 for s in sizes)
    assert sorted(first) == sorted(mixing.mix(spark, df.repartition(3)).collect())
    again = Counter(r.doc_id for r in mixing.mixed_documents(spark, df).collect())
    assert again == Counter({r.doc_id: r.taken // r.size for r in first if r.taken})


def test_mix_of_odd_rows(spark, odd_docs, no_docs):
    rows = mixing.mix(spark, odd_docs).collect()
    assert len(rows) == 12 and all(r.taken <= 3 * r.size for r in rows)
    out = mixing.mixed_documents(spark, odd_docs)
    assert out.columns == odd_docs.columns
    assert sum(len((r.text or "").split()) for r in out.collect()) == sum(r.taken for r in rows)
    assert mixing.mix(spark, no_docs).count() == 0 and mixing.mixed_documents(spark, no_docs).count() == 0
    empty = odd_docs.filter("doc_id in (3, 4, 5)")
    assert [r.target for r in mixing.mix(spark, empty).collect()] == [0.0] * 3
