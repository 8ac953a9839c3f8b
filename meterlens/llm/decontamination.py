"""Benchmark decontamination: an FM-index per training shard, searched for all windows of benchmark items.

A shard is a run of whole documents of one task, about ``SHARD_WORDS`` words.  Its words become symbols of
the benchmark's own vocabulary; runs of other words become one separator that no window can cross, which
keeps the index small and loses nothing.  Windows (10 words, or a whole shorter item) are found by backward
search, occurrences located by sampled suffix positions and merged to spans of words to remove.

The benchmark is the stated query set.  It is dealt in blocks of at most ``BLOCK_WINDOWS`` windows, each
searched in all documents by a job of its own, so what is sent to tasks has a fixed bound.

Defined cases: null, empty or wordless texts have no words and no hits; items with null ids count as one
item with an empty id; items of equal id are one item, items of equal text each count; repeated
documents each get the same result; other columns are passed through or ignored; an empty benchmark or table
gives no hits.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlens.llm.common import read, staged
from meterlens.llm.fm_index import FmIndex
from meterlens.llm.textnum import slices

WINDOW = 10
SHARD_WORDS = 1 << 19
BLOCK_WINDOWS = 200_000

_keep = bytes(range(48, 58)) + bytes(range(97, 123)) + bytes(range(128, 256))
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b in _keep else 32 for b in range(256))


def item_words(text: str | None) -> list[bytes]:
    """Words of a text: ASCII letters in lower case, digits, everything outside ASCII."""
    return (text or "").encode().translate(_TO_WORDS).split()


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct (window, items): ``words array<string>, items array<string>``."""
    lower = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.array_remove(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words.alias("w")).filter("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))
    rows = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("words"))
    return rows.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))


class _Block:
    """Windows of one block as symbols of their own vocabulary: 1 is the separator, words follow."""

    def __init__(self, rows: list):
        self.items = [r["items"] for r in rows]
        phrases = [[w.encode() for w in r["words"]] for r in rows]
        self.symbols = {w: k + 2 for k, w in enumerate(sorted({w for p in phrases for w in p}))}
        self.lengths = np.array([len(p) for p in phrases], np.int64)
        self.phrases = np.zeros((len(phrases), max(map(len, phrases), default=1)), np.int64)
        for k, p in enumerate(phrases):
            self.phrases[k, : len(p)] = [self.symbols[w] for w in p]
        self.shortest = int(self.lengths.min(initial=WINDOW))


def _shard_hits(block: _Block, symbols: np.ndarray, owner_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start words, windows) of all occurrences in the shard's words.  ``symbols`` is 0 outside the vocabulary."""
    known = symbols > 0
    edge = np.zeros(len(symbols) + 1, bool)
    edge[0] = True
    edge[owner_ends] = True
    start = known & (edge[:-1] | ~np.append(False, known[:-1]))
    first = np.flatnonzero(start)
    stop = np.flatnonzero(known & (edge[1:] | ~np.append(known[1:], False))) + 1
    long_enough = stop - first >= block.shortest
    first, stop = first[long_enough], stop[long_enough]
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # the runs one after the other, a separator behind each
    sizes = stop - first + 1
    ends = np.cumsum(sizes)
    source = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes) + np.repeat(first, sizes)
    text = symbols[np.minimum(source, len(symbols) - 1)]
    text[ends - 1] = 1
    index = FmIndex(text, len(block.symbols) + 1)
    lo, hi = index.search(block.phrases, block.lengths)
    counts = hi - lo
    which = np.repeat(np.arange(len(lo)), counts)
    rows = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(lo, counts)
    return source[index.locate(rows)], which


def _scan(block: _Block, batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows (text, spans, items, ...) with the block's hits added to spans and items."""
    held: list[tuple[pa.RecordBatch, list[np.ndarray]]] = []
    total = 0
    look = block.symbols.get
    for batch in batches:
        for part in slices(batch, "text"):
            texts = []
            for text in part.column("text").to_pylist():
                found = item_words(text)
                texts.append(np.array([look(w, 0) for w in found], np.int32))
                total += len(found)
            held.append((part, texts))
            if total >= most:
                yield from _flush(block, held)
                held, total = [], 0
    if held:
        yield from _flush(block, held)


def _merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return out


def _flush(block: _Block, held: list) -> Iterator[pa.RecordBatch]:
    texts = [t for _, many in held for t in many]
    counts = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(counts)
    at, which = _shard_hits(block, np.concatenate(texts).astype(np.int64), ends) if len(texts) else (counts, counts)
    owner = np.searchsorted(ends, at, side="right")
    order = np.lexsort((at, owner))
    at, which, owner = at[order], which[order], owner[order]
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    row = 0
    for part, many in held:
        spans, items = part.column("spans").to_pylist(), part.column("items").to_pylist()
        for k in range(len(many)):
            lo, hi = bounds[row + k], bounds[row + k + 1]
            if lo < hi:
                begins = at[lo:hi] - (ends[row + k] - counts[row + k])
                found = np.stack([begins, begins + block.lengths[which[lo:hi]]], axis=1).tolist()
                spans[k] = _merged(spans[k] + found)
                items[k] = sorted({*items[k], *(i for w in set(which[lo:hi].tolist()) for i in block.items[w])})
        names = part.schema.names
        columns = {name: part.column(name) for name in names} | {
            "spans": pa.array(spans, pa.list_(pa.list_(pa.int32()))),
            "items": pa.array(items, pa.list_(pa.string())),
            "n_words": pa.array(counts[row : row + len(many)]),
        }
        yield pa.RecordBatch.from_arrays([columns[name] for name in names], names)
        row += len(many)


def _scan_with(block: _Block, most: int):
    return lambda batches: _scan(block, batches, most)


def benchmark_hits(
    spark: SparkSession,
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = WINDOW,
    shard_words: int = SHARD_WORDS,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """``row`` (the document as a struct), ``n_words, spans, items``: merged word spans [from, to) of all windows that occur."""
    stated = staged(spark, windows(benchmark, size), "windows")
    pairs = stated.agg(F.sum(F.size("items"))).first()[0] or 0
    blocks = max(1, math.ceil(2 * pairs / block_windows))
    rows = docs.select(
        F.struct(*[F.col(c) for c in docs.columns]).alias("row"),
        "text",
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<array<int>>").alias("spans"),
        F.array().cast("array<string>").alias("items"),
    )
    for k in range(blocks):
        part = stated.filter(F.pmod(F.xxhash64("words"), F.lit(blocks)) == k).collect()
        rows = rows.mapInArrow(_scan_with(_Block(part), shard_words), rows.schema)
        if k + 1 < blocks:
            rows = staged(spark, rows, "searched")
    return rows.drop("text")


def decontaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no window occurs."""
    return benchmark_hits(spark, docs, benchmark).filter("size(spans) = 0").select("row.*")


_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def without_spans(text: str, spans: list[list[int]]) -> str:
    """The text without its words in ``spans`` and what stands between them."""
    data = text.encode()
    words = [m.span() for m in _WORD.finditer(data)] if spans else []
    out, at = [], 0
    for begin, end in spans:
        out.append(data[at : words[begin][0]])
        at = words[end - 1][1]
    return b"".join([*out, data[at:]]).decode()


def op6_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    hits = benchmark_hits(spark, docs, read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return hits.select(
        "row.doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, [x FOR x IN string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w
  FROM documents
), b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, [x FOR x IN string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item, array_to_string(w[i:i + 9], ' ') AS g, len(w[i:i + 9]) AS n
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)
), ns AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns)
), occ AS (SELECT dw.doc_id, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM occ) GROUP BY 1),
it AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY 1
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
