"""Cross-tokenizer alignment, periodic runs and piece coding against brute force and the libraries."""

import hashlib
import random
import sys
import tracemalloc
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meterlens.llm import periodic_runs as runs
from meterlens.llm import piece_codec as codec
from meterlens.llm import token_alignment as align
from meterlens.llm.packing import vocabulary

SF_DIR = "/root/testdata/sf0.001"


def sha(text) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=codec.MODEL)


@pytest.fixture(scope="module")
def byte_level():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(align.BYTE_LEVEL)
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def aligner():
    files = vocabulary(align.BYTE_LEVEL), vocabulary(codec.MODEL)
    return align.Aligner(*files, align.Pairs(align.side_a(files[0]), align.side_b(files[1])).keys)


def odd_texts(n: int, seed: int = 5) -> list[str]:
    rng = random.Random(seed)
    bits = [*" abethinrs\n\t\0é漢ﬁ▁", "\U0001f600", "the", "  ", "   ", " " * 17, "<s>", "<0x41>", "<|endoftext|>", "é", "'ll", "2024"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(n)]


# ---- SentencePiece ------------------------------------------------------------


@pytest.fixture(scope="module")
def coder():
    return codec.PieceCodec(vocabulary(codec.MODEL))


def test_ids_are_those_of_the_library(coder, library, texts):
    every = [t or "" for _, t in texts] + odd_texts(4000)
    assert [coder.encode(t) for t in every] == library.encode(every)


def test_every_code_point(coder, library):
    points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 4096):
        text = "".join(f"a{chr(c)}b {chr(c)}" for c in points[at : at + 4096])
        assert coder.encode(text) == library.encode(text)


def test_long_words_are_linear_and_exact(coder, library):
    rng = random.Random(3)
    for text in ("a" * 50_000, "the" * 20_000, " " * 30_000, "".join(rng.choice("etaoin") for _ in range(40_000))):
        assert coder.encode(text) == library.encode(text)


def test_pieces_are_found_by_giving_up_longest_matches(coder):
    """The greedy longest match alone gives other pieces."""
    text = "▁thheingble"
    greedy, at = [], 0
    while at < len(text):
        size = max(n for n in range(1, len(text) - at + 1) if text[at : at + n] in coder.ids)
        greedy.append(text[at : at + size])
        at += size
    assert coder.pieces(text) == coder.merged(text)
    words = [f"▁{a}{b}{c}" for a in ("en", "th", "ou") for b in ("nde", "ist", "ingt") for c in ("hat", "ons", "erst")]
    assert all(coder.pieces(w) == coder.merged(w) for w in words)
    assert any(coder.pieces(w) != coder.pieces(w[:5]) + coder.pieces(w[5:]) for w in words)
    assert greedy


def test_any_ids_are_decoded_like_the_library(coder, library):
    rng = random.Random(4)
    for _ in range(3000):
        ids = [rng.choice([rng.randint(0, 300), rng.randint(0, 31_999), 259, 29_871]) for _ in range(rng.randint(0, 8))]
        assert coder.decode(ids) == library.decode(ids)


def test_models_of_another_kind_are_refused():
    with pytest.raises(ValueError):
        codec.PieceCodec(b"\x0a\x08\x0a\x01a\x15\x00\x00\x00\x00" + b"\x12\x02\x18\x01" + b"\x1a\x00")


def _coded(library, text):
    ids = library.encode(text or "")
    return len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))


def test_op13(spark, library, texts):
    got = {r.doc_id: tuple(r)[1:] for r in codec.op13_piece_codec(spark, SF_DIR).collect()}
    assert got == {doc: _coded(library, text) for doc, text in texts}


def test_codec_of_odd_rows(spark, library, odd_docs, no_docs):
    rows = codec.decoded(codec.encoded(odd_docs, "doc_id", "words", "text", "row"), "doc_id", "ids", "text", "words")
    got = Counter((r.doc_id, tuple(r.ids), r.decoded, r.words) for r in rows.collect())
    want = Counter((r.doc_id, tuple(library.encode(r.text or "")), r.text or "", r.words) for r in odd_docs.collect())
    assert got == want
    assert codec.encoded(no_docs, "doc_id").count() == 0
    with pytest.raises(ValueError):
        codec.encoded(odd_docs.withColumn("ids", F.lit(1)), "ids")


# ---- periodic runs ------------------------------------------------------------


def brute_runs(w: list) -> list[tuple[int, int, int]]:
    """Every period in turn: maximal stretches of equal words q apart, without those of a smaller period."""
    out = []
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if size >= max(24, 3 * q) and not any(all(w[k] == w[k + r] for k in range(i, i + size - r)) for r in range(1, q)):
                out.append((i, size, q))
            i = j + 1
    return sorted(out)


def some_words(rng: random.Random) -> list[int]:
    n, kinds = rng.randint(0, 140), rng.choice([1, 2, 3, 5, 50])
    w = [rng.randrange(kinds) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        if n > 10:
            a = rng.randrange(n)
            p = 1 + rng.randrange(max(1, (n - a) // 2))
            for i in range(a, min(n, a + rng.randint(20, 100))):
                w[i] = w[a + (i - a) % p]
    return w


def test_runs_are_those_of_brute_force():
    rng = random.Random(6)
    for _ in range(400):
        w = some_words(rng)
        assert runs.runs_of(w) == brute_runs(w)


def test_runs_end_where_a_word_differs():
    w = [*range(100, 110), *([1, 2, 3] * 9)[:25], *range(200, 210)]
    assert runs.runs_of(w) == [(10, 25, 3)]
    assert runs.runs_of(([1, 2, 3] * 8)[:23]) == [] and runs.runs_of([*range(9)] * 2 + [*range(8)]) == []


def test_long_runs_take_linear_time():
    for n, p in ((60_000, 1), (60_000, 20_000)):
        assert runs.runs_of([i % p for i in range(n)]) == [(0, n, p)]


def test_suffix_links_are_last_occurrences():
    """Colours of a path against the last occurrences of all suffixes."""
    rng = random.Random(7)
    for _ in range(60):
        w = [rng.randrange(2) for _ in range(rng.randint(1, 40))]
        tree = runs.SuffixTree(w)
        paths = runs.PreferredPaths(tree.link)
        for i, state in enumerate(tree.prefix):
            met = paths.access(state, i)
            for size in range(1, i + 2):
                low = next((low, ended) for low, ended in reversed(met) if tree.length[low] >= size)
                last = max((e for e in range(size - 1, i) if w[e - size + 1 : e + 1] == w[i - size + 1 : i + 1]), default=-1)
                assert low[1] == last


def test_runs_of_odd_rows(spark, odd_docs, no_docs):
    again = "x " * 30 + "y"
    rows = odd_docs.select("doc_id", "text", "words").union(spark.createDataFrame([(9, again, "w"), (9, again, "w"), (None, again, "w")], "doc_id long, text string, words string"))
    got = Counter((r.doc_id, r.words, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in runs.periodic_runs(rows, "doc_id", "words").collect())

    def want(text):
        w = (text or "").encode().split()
        found = brute_runs(w) if len(w) < 1000 else []
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        return len(w), tuple(found), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()

    assert got == Counter((r.doc_id, r.words, *want(r.text)) for r in rows.collect())
    assert runs.periodic_runs(no_docs, "doc_id").count() == 0
    with pytest.raises(ValueError):
        runs.periodic_runs(odd_docs.withColumn("runs", F.lit(1)), "runs")


def _expected_runs(doc, text):
    w = (text or "").encode().split()
    n, h = len(w), zlib.crc32(str(doc).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w) if n < 700 else runs.runs_of(w)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    return (
        len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{size},{q}\n" for s, size, q in found)), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


def test_op12(spark, texts):
    got = {r.doc_id: tuple(r)[1:] for r in runs.op12_periodic_runs(spark, SF_DIR).collect()}
    want = {doc: _expected_runs(doc, text) for doc, text in texts}
    assert got == want
    assert sum(x[0] > 0 for x in want.values()) > len(want) // 50


# ---- alignment ------------------------------------------------------------------


def some_ends(rng: random.Random, size: int) -> np.ndarray:
    return np.array(sorted({size, *rng.sample(range(1, size + 1), rng.randint(0, size))}))


def test_pieces_are_stitched_to_the_whole(aligner):
    rng = random.Random(8)
    for _ in range(400):
        size = rng.randint(1, 60)
        a_ends, b_ends = some_ends(rng, size), some_ends(rng, size)
        a_ids, b_ids = np.arange(len(a_ends)) + 1, np.arange(len(b_ends)) + 1
        groups, i, j = [], 0, 0
        for end in sorted({*a_ends.tolist()} & {*b_ends.tolist()}):
            x, y = a_ends.tolist().index(end) + 1, b_ends.tolist().index(end) + 1
            groups.append(",".join(map(str, a_ids[i:x])) + "|" + ",".join(map(str, b_ids[j:y])))
            i, j = x, y
        begin = lambda ends, k: ends[k - 1] if k else 0
        overlaps = {
            (x, y) for x in range(len(a_ends)) for y in range(len(b_ends)) if max(begin(a_ends, x), begin(b_ends, y)) < min(a_ends[x], b_ends[y])
        }
        for steps in (1, 2, 5, 200):
            pieces = align.cut(a_ids, a_ends, b_ids, b_ends, steps)
            assert {len(p.a_ids) + len(p.b_ids) for p in pieces[:-1]} <= {steps}
            emitted = [(x + p.a_from, y + p.b_from) for p in pieces for x, y, _ in zip(*p.overlaps(), strict=True)]
            assert {*emitted} == overlaps
            parts = []
            for p in pieces:
                a, b, closed = p.overlaps()
                a, b = a[closed] + 1, b[closed] + 1
                first, last = ((a[0], b[0]), (a[-1], b[-1])) if len(a) else ((len(p.a_ids), len(p.b_ids)),) * 2
                body = aligner.written(p.a_ids[first[0] : last[0]], p.b_ids[first[1] : last[1]], a[1:] - first[0], b[1:] - first[1])
                parts.append({
                    "n_groups": len(a), "body": "".join(body), "head_a": p.a_ids[: first[0]].tolist(), "head_b": p.b_ids[: first[1]].tolist(),
                    "tail_a": p.a_ids[last[0] :].tolist(), "tail_b": p.b_ids[last[1] :].tolist(),
                })
            assert align.stitched(parts) == ";".join(groups)


def test_side_a_is_that_of_the_library(aligner, byte_level):
    points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}b {chr(c)}1 {chr(c)}  " for c in points[at : at + 512]) for at in range(0, len(points), 512)] + odd_texts(2000)
    theirs = [e.ids for e in byte_level.encode_batch([" " + t for t in texts], add_special_tokens=False)]
    assert [aligner._encode_a(" " + t) for t in texts] == theirs


class Brute:
    """Links and groups straight from the offsets, with the libraries' own tokens."""

    def __init__(self, rows, byte_level, library):
        a_bytes, b_bytes = align.side_a(vocabulary(align.BYTE_LEVEL)), align.side_b(vocabulary(codec.MODEL))
        self.rows, self.pairs = [], Counter()
        for doc, text in rows:
            a = byte_level.encode(" " + text, add_special_tokens=False).ids if text else []
            b = library.encode(text or "")
            whole = (" " + (text or "")).encode()
            if not text or b"".join(a_bytes[k] for k in a) != whole or b"".join(b_bytes[k] for k in b) != whole:
                a, b = [], []
            a_at = {e: k for k, e in enumerate(np.cumsum([len(a_bytes[k]) for k in a]).tolist())}
            b_at = {e: k for k, e in enumerate(np.cumsum([len(b_bytes[k]) for k in b]).tolist())}
            groups, links, i, j = [], [], 0, 0
            for end in sorted(a_at.keys() & b_at.keys()):
                x, y = a_at[end] + 1, b_at[end] + 1
                groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
                links.append((a[x - 1], b[y - 1]))
                i, j = x, y
            self.pairs.update(links)
            self.rows.append((doc, len(a), len(b), groups, links))
        self.best = defaultdict(int)
        for (_, b), n in self.pairs.items():
            self.best[b] = max(self.best[b], n)

    def result(self):
        return Counter(
            (doc, n_a, n_b, len(groups), len(links), sum(self.pairs[p] == self.best[p[1]] for p in links), sum(self.pairs[p] for p in links), ";".join(groups))
            for doc, n_a, n_b, groups, links in self.rows
        )


def _aligned(rows):
    counted = align.with_counts(rows, align.pair_counts(rows))
    return Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, len(r.l), r.n_best, r.count_sum, r.groups) for r in counted.collect())


@pytest.mark.parametrize("long_bytes,steps", [(align.LONG_BYTES, align.PIECE_STEPS), (100, 64), (0, 3)])
def test_alignment_of_odd_rows(spark, odd_docs, no_docs, byte_level, library, long_bytes, steps):
    docs = odd_docs.filter("doc_id is null or doc_id != 6") if steps == 3 else odd_docs
    extra = [(None, t) for t in odd_texts(150)] + [(50, "literal ▁ here"), (51, "<|endoftext|> and <s>"), (51, "<|endoftext|> and <s>")]
    docs = docs.select("doc_id", "text", F.col("words").alias("w")).union(spark.createDataFrame([(*x, "w") for x in extra], "doc_id long, text string, w string"))
    rows = align.aligned(spark, docs, "doc_id", "w", long_bytes=long_bytes, steps=steps).withColumn("l", F.col("links"))
    want = Brute([(r.doc_id, r.text) for r in docs.collect()], byte_level, library)
    assert _aligned(rows) == want.result()
    assert align.aligned(spark, no_docs, "doc_id", long_bytes=long_bytes).count() == 0
    with pytest.raises(ValueError):
        align.aligned(spark, odd_docs.withColumn("groups", F.lit(1)), "groups")


def test_op11(spark, texts, byte_level, library):
    got = Counter(tuple(r) for r in align.op11_token_alignment(spark, SF_DIR).collect())
    want = Brute(texts, byte_level, library).result()
    assert got == Counter((*x[:-1], sha(x[-1]) if x[1] else "") for x in want.elements())


def test_linked_ids_end_alike(aligner):
    """The bound on id pairs: each is a number of ``Pairs``."""
    keys = aligner.pairs.keys
    assert len(keys) < 500_000
    for key in keys[:: len(keys) // 1000].tolist():
        a, b = aligner.a[key // aligner.pairs.width], aligner.b[key % aligner.pairs.width]
        assert a.endswith(b) or b.endswith(a)


def test_counts_of_a_batch_are_looked_up_in_runs():
    # a batch of 10,000 texts holds millions of links: the figures of all at once do not fit beside the other tasks
    rng = np.random.default_rng(3)
    lengths = np.append(rng.integers(0, 800, 10_000), [0, 300_000, 0])
    ends = np.append(0, np.cumsum(lengths))
    links = rng.integers(0, 1000, ends[-1]).astype(np.int32)
    count, best = rng.integers(1, 1 << 40, 1000), rng.random(1000) < 0.5
    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(links))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(lengths))), lists], ["doc_id", "links"])
    tracemalloc.start()
    out = pa.Table.from_batches(align._counted(iter([batch, batch.slice(0, 0), batch.slice(10_000)]), best, count, ["doc_id"]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20 < ends[-1] * 8
    want = [(k, int(best[links[a:b]].sum()), int(count[links[a:b]].sum())) for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False))]
    assert [tuple(r.values()) for r in out.to_pylist()] == want + want[10_000:]


def test_passes_of_op11_get_small_batches(spark, tmp_path, monkeypatch):
    # 10,000 texts or lists of links at once stood beside the heap as vectors, as the stream to Python, and there
    rows = [(1, "a text, and some more of it"), (1, "a text, and some more of it"), (None, None), (2, "x" * 100_000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    seen = {}

    def sizes(batches):
        yield from (pa.RecordBatch.from_pydict({"size": [batch.nbytes]}) for batch in batches)

    def spy(spark, df, purpose, _staged=align.staged):
        texts = spark.range(0, 6000, 1, 1).select(F.repeat(F.lit("x"), 3000))
        seen[purpose] = max(r.size for r in texts.mapInArrow(sizes, "size long").collect())
        return _staged(spark, df, purpose)

    monkeypatch.setattr(align, "staged", spy)
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    assert spark.conf.get(setting, None) is None
    got = align.op11_token_alignment(spark, str(tmp_path))
    assert [*seen] == ["pieces", "links", "counted"] and max(seen.values()) < 5 << 20
    assert spark.conf.get(setting, None) is None
    assert Counter(r.doc_id for r in got.collect()) == {1: 2, None: 1, 2: 1}
    # a size that the session has set is kept, also when a pass fails
    try:
        spark.conf.set(setting, "1m")
        align.op11_token_alignment(spark, str(tmp_path))
        assert max(seen.values()) < 2 << 20 and spark.conf.get(setting) == "1m"
    finally:
        spark.conf.unset(setting)
    with pytest.raises(Exception, match="nowhere"):
        align.op11_token_alignment(spark, f"{tmp_path}/nowhere")
    assert spark.conf.get(setting, None) is None
