"""Operators 7 and 9 against brute force."""

import random

import pytest

from meterlens.llm import line_dedup, minhash


class Groups(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def _shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _components(rows):
    groups, sets = Groups(), [(i, _shingles(t)) for i, t in rows]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                groups.join(i, j)
    return {i: (len(s), groups.find(i)) for i, s in sets}


def _edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def test_components_match_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for g in range(25):
        base = [f"b{g}w{rng.randrange(500)}" for _ in range(rng.choice([3, 8, 30, 120]))]
        rows += [" ".join(_edited(rng, base, rng.randint(0, 1 + len(base) // 12))) for _ in range(rng.randint(1, 12))]
    # a chain: neighbours are linked, ends are not
    chain = [f"c{i}" for i in range(200)]
    for k in range(12):
        rows.append(" ".join([*chain[15 * k // 2 :], *(f"d{i}" for i in range(15 * k // 2))]))
    # many documents around one passage, with different rests
    passage = [f"p{i}" for i in range(40)]
    rows += [" ".join([*passage, *(f"r{k}x{i}" for i in range(15))]) for k in range(30)]
    rows = list(enumerate(rows))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark, df).collect()}
    assert got == _components(rows)
    kept = {r.doc_id for r in minhash.deduplicated(spark, df).collect()}
    assert kept == {i for i, (_, c) in got.items() if i == c}


def test_threshold_is_exact(spark):
    # 3 shingles in common of 4, and 5 of 7
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g h"), (3, "n o p q r s t u v"), (4, "n o p q r s t u v x y"), (5, "A B c d e f g")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(spark, df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 1}


def test_near_dedup_of_odd_rows(spark, odd_docs, no_docs):
    rows = minhash.near_duplicates(spark, odd_docs).collect()
    assert len(rows) == 12
    ids = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in rows}
    assert ids[1, 3] == (1, True) and ids[2, 3] == (1, False) and ids[2, 6] == (2, True)
    assert ids[3, 0] == (3, True) and ids[4, 0] == (4, True) and ids[None, 5] == (None, True)
    out = minhash.deduplicated(spark, odd_docs)
    assert out.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted("1 2 3 4 5 None 6 7 8".split())
    assert minhash.near_duplicates(spark, no_docs).count() == 0 and minhash.deduplicated(spark, no_docs).count() == 0


def _distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


@pytest.mark.parametrize("threshold", [1, 2, 4])
def test_banded_distance_and_probes(threshold):
    rng = random.Random(threshold)
    pairs = []
    while len(pairs) < 800:
        a = "".join(rng.choice("abé") for _ in range(rng.randint(threshold + 1, 24)))
        b = a
        for _ in range(rng.randint(0, threshold + 2)):
            k = rng.randint(0, len(b))
            b = b[:k] + rng.choice(["", "a", "b", "é"]) + b[k + rng.randint(0, 1) :]
        if len(b) > threshold:
            pairs.append((a, b))
    got = line_dedup.within([a for a, _ in pairs], [b for _, b in pairs], threshold)
    assert got.tolist() == [min(_distance(a, b), threshold + 1) for a, b in pairs]
    for (a, b), far in zip(pairs, got.tolist(), strict=True):
        short, long = sorted((a, b), key=len)
        if far <= threshold:
            held = {(len(short), i, short[s : s + n]) for i, (s, n) in enumerate(line_dedup.segments(len(short), threshold))}
            own = {(len(long), i, long[s : s + n]) for i, (s, n) in enumerate(line_dedup.segments(len(long), threshold))}
            assert held & ({(m, i, long[s : s + n]) for m, i, s, n in line_dedup.probes(len(long), threshold)} | own)


def test_keys_tell_substrings_apart():
    import pyarrow as pa

    lines = ["abcdefghijklmnop", "qrstuvwxyzabcdef", "abcdeXXXijklmnop", "xx" * 9]
    batch = pa.record_batch({"line_id": pa.array(range(4)), "line": pa.array(lines)})
    (out,) = line_dedup._keys(iter([batch]), 2)
    rows = zip(out.column("line_id").to_pylist(), out.column("key").to_pylist(), out.column("entry").to_pylist(), strict=True)
    sets = {k: set() for k in range(4)}
    for k, key, entry in rows:
        if entry:
            sets[k].add(key)
    assert not sets[0] & sets[1] and len(sets[0] & sets[2]) == 2 and all(len(s) == 3 for s in sets.values())


def test_keys_that_span_batches_are_met_whole():
    import pyarrow as pa

    rows = [(1, 5, True), (1, 6, False), (2, 7, True), *[(3, k, k % 2 == 0) for k in range(40)], (4, 1, True), (4, 1, False), (5, 2, False), (5, 3, False)]
    batches = [pa.record_batch({"key": [r[0] for r in part], "line_id": [r[1] for r in part], "entry": [r[2] for r in part]})
               for part in (rows[i : i + 7] for i in range(0, len(rows), 7))]
    for fresh in (1 << 18, 5):
        line_dedup.FRESH, before = fresh, line_dedup.FRESH
        out = pa.Table.from_batches(line_dedup._met(iter(batches), 10)).to_pylist()
        line_dedup.FRESH = before
        assert [(r["x"], r["y"]) for r in out if not r["hot"]] == [(5, 6)]
        assert [(r["x"], r["y"], r["entry"]) for r in out if r["hot"]] == [r for r in rows if r[0] == 3]


@pytest.mark.parametrize("few,block", [(64, 256), (1, 3)])
def test_line_links_match_brute_force(spark, monkeypatch, few, block):
    monkeypatch.setattr(line_dedup, "FEW", few)
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    rng = random.Random(3)
    base = ["".join(rng.choice("abcde fg") for _ in range(rng.randint(9, 40))).strip() for _ in range(40)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rng.randint(0, 5)):
            b = rng.choice(base)
            for _ in range(rng.randint(0, 3)):
                k = rng.randint(0, len(b))
                b = b[:k] + rng.choice(["", "x"]) + b[k + rng.randint(0, 1) :]
            lines.append(rng.choice(["", " "]) + b)
        rows.append((d, "\n".join(lines)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    lines = line_dedup.document_lines(df)
    text = {r.line_id: r.line for r in lines.collect()}
    ids = sorted(i for i in text if len(text[i]) >= line_dedup.MIN_CHARS)
    expected = {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if _distance(text[a], text[b]) <= 2}
    assert {(r.a, r.b) for r in line_dedup.linked_lines(spark, lines).collect()} == expected
    groups = Groups()
    for a, b in expected:
        groups.join(a, b)
    out = line_dedup.line_classes(spark, df).collect()
    assert len(out) == lines.count()
    first = {}
    for r in sorted(out, key=lambda r: (r.doc_id, r.line_no)):
        assert r.class_id == groups.find(r.line_id)
        assert r.n_links == sum(r.line_id in pair for pair in expected)
        assert r.kept == (first.setdefault(r.class_id, (r.doc_id, r.line_no)) == (r.doc_id, r.line_no))


def test_distances_of_short_strings():
    rng = random.Random(8)
    words = ["".join(rng.choice("ab ") for _ in range(rng.randint(0, 6))) for _ in range(60)]
    pairs = [(a, b) for a in words for b in words]
    for threshold in (1, 2, 3):
        got = line_dedup.within([a for a, _ in pairs], [b for _, b in pairs], threshold)
        assert got.tolist() == [min(_distance(a, b), threshold + 1) for a, b in pairs]


@pytest.mark.parametrize("few,block", [(64, 256), (1, 3)])
def test_short_lines_are_linked_too(spark, monkeypatch, few, block):
    monkeypatch.setattr(line_dedup, "FEW", few)
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    rng = random.Random(4)
    texts = {"".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 14))) for _ in range(150)} | {"Le | treque.", "Le treque.", "a", "é"}
    df = spark.createDataFrame(list(enumerate(sorted(texts))), "doc_id long, text string").repartition(3)
    lines = line_dedup.document_lines(df)
    text = {r.line_id: r.line for r in lines.collect()}
    ids = sorted(text)
    expected = {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if _distance(text[a], text[b]) <= 2}
    assert {(r.a, r.b) for r in line_dedup.linked_lines(spark, lines).collect()} == expected


def test_lines_of_odd_rows(spark, odd_docs, no_docs):
    rows = line_dedup.line_classes(spark, odd_docs).collect()
    assert {r.doc_id for r in rows} == {1, 2, 6, 7, 8, None}
    assert line_dedup.line_classes(spark, no_docs).count() == 0
