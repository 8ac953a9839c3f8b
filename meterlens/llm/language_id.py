"""Language identification by error-correcting output codes.

Every language gets a codeword; for each bit a binary classifier, naive Bayes over hashed byte n-grams (3 and 4
bytes of lower-cased text), says how strongly a text speaks for 1 or 0: the mean log odds per n-gram times the
square root of their number, up to a limit.  Loss-weighted decoding charges each codeword log(1 + exp(-margin)) for every bit
and takes the least loss; ``score`` is the share of that codeword under exp(-loss), and a text is ambiguous
where the second codeword is within ``AMBIGUOUS`` of it.

Codes: up to 7 languages all 2^(k-1) - 1 ways to split them in two; beyond that, seeded random words of
8 * ceil(log2 k) bits, the most distant of 64 draws.  Counts are gathered over all training documents: crc32
of the id as text, modulo 4, is not 2 and lang is known.  What goes to the driver is one count per language and bucket.

Defined cases: a null text or one without a letter is ``und`` with score 0 and not ambiguous; a null doc_id is
not held out and not learned from; repeated rows count as often as they occur; equal losses go to the first
language by code point; with no training rows everything is ``und``; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlens.llm.common import read
from meterlens.llm.textnum import ASCII_LOWER, IS_SPACE, buffers, slices

BUCKETS = 1 << 15
SMOOTH = 0.5
MOST = 400  # n-grams beyond which a margin no longer grows
AMBIGUOUS = 1.0
_FOLD = np.where(IS_SPACE, 32, ASCII_LOWER).astype(np.uint64)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all n-grams, owner text of each)."""
    data, offsets = buffers(texts)
    codes = _FOLD[data]
    owner = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(offsets))
    buckets, owners = [], []
    for size in (3, 4):
        if len(codes) < size:
            continue
        gram = codes[: len(codes) - size + 1].copy()
        for j in range(1, size):
            gram |= codes[j : len(codes) - size + 1 + j] << np.uint64(8 * j)
        inside = owner[: len(gram)] == owner[size - 1 :]
        gram = ((gram | np.uint64(size << 32)) * _FACTOR) >> np.uint64(64 - 15)
        buckets.append(gram[inside].astype(np.int64))
        owners.append(owner[: len(gram)][inside])
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(owners)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in slices(batch, "text"):
            langs = part.column("lang").dictionary_encode()
            own = np.asarray(langs.indices)
            buckets, owner = _grams(part.column("text"))
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                found = np.bincount(buckets[own[owner] == k], minlength=BUCKETS)
                counts[lang] = counts[lang] + found if lang in counts else found
    for lang, found in counts.items():
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(found[some])], ["lang", "bucket", "n"])


def codewords(k: int) -> np.ndarray:
    """A 0/1 matrix with a row for each of ``k`` languages."""
    if k == 1:
        return np.ones((1, 1), np.int8)
    if k <= 7:
        # every split of the languages in two that puts the first on side 1
        splits = np.arange(2 ** (k - 1) - 1)
        rest = (splits[None, :] >> np.arange(k - 1)[:, None]) & 1
        return np.vstack([np.ones(len(splits), np.int64), rest]).astype(np.int8)
    draw, best, width = np.random.default_rng(k), None, 8 * math.ceil(math.log2(k))
    for _ in range(64):
        words = draw.integers(0, 2, (k, width)).astype(np.int8)
        signs = 2 * words.astype(np.int32) - 1
        apart = (width - signs @ signs.T) // 2
        near = apart[~np.eye(k, dtype=bool)].min()
        if best is None or near > best[0]:
            best = (near, words)
    return best[1]


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        self.code = codewords(len(langs))
        share = counts + SMOOTH
        share = share / share.sum(axis=1, keepdims=True)
        odds = []
        for bit in self.code.T:
            # each side is the mean of its languages, however many documents they have
            one = share[bit == 1].mean(axis=0) if (bit == 1).any() else np.full(BUCKETS, 1 / BUCKETS)
            two = share[bit == 0].mean(axis=0) if (bit == 0).any() else np.full(BUCKETS, 1 / BUCKETS)
            odds.append(np.log(one / two))
        self.odds = np.array(odds)

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, score, gap to the second best loss) of each text."""
        n = len(texts)
        buckets, owner = _grams(texts)
        grams = np.maximum(np.bincount(owner, minlength=n), 1)
        margins = np.stack([np.bincount(owner, weights=row[buckets], minlength=n) for row in self.odds], axis=1)
        margins = margins / grams[:, None] * np.sqrt(np.minimum(grams, MOST))[:, None]
        signs = 2.0 * self.code - 1.0
        losses = np.stack([np.logaddexp(0, -margins * word).sum(axis=1) for word in signs], axis=1)
        best = losses.argmin(axis=1)
        ranked = np.sort(losses, axis=1)
        score = 1 / np.exp(ranked[:, :1] - ranked).sum(axis=1)
        gap = ranked[:, 1] - ranked[:, 0] if len(signs) > 1 else np.full(n, np.inf)
        return best, score, gap


def trained(docs: DataFrame) -> Model | None:
    """The model from ``docs`` (text, lang): gathers languages x BUCKETS counts."""
    rows = docs.filter("lang is not null and text is not null").select("lang", "text")
    counts = rows.mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    if not counts.num_rows:
        return None
    langs = sorted(set(counts.column("lang").to_pylist()))
    table = np.zeros((len(langs), BUCKETS))
    place = {lang: k for k, lang in enumerate(langs)}
    table[[place[x] for x in counts.column("lang").to_pylist()], np.asarray(counts.column("bucket"))] = np.asarray(counts.column("n"))
    return Model(langs, table)


def _predict(batches: Iterator[pa.RecordBatch], model: Model | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            lettered = np.asarray(part.column("lettered").to_numpy(zero_copy_only=False), bool)
            if model is None:
                langs, score, unsure = ["und"] * part.num_rows, np.zeros(part.num_rows), np.zeros(part.num_rows, bool)
            else:
                best, score, gap = model.predict(part.column("text"))
                langs = [model.langs[b] if ok else "und" for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
                score, unsure = np.where(lettered, score, 0.0), lettered & (gap < AMBIGUOUS)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("held_out"), pa.array(langs, pa.string()), pa.array(score), pa.array(unsure)],
                ["doc_id", "held_out", "lang_pred", "score", "ambiguous"],
            )


def identified(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, ambiguous`` of every row of ``docs`` (doc_id, text, lang)."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = trained(docs.filter(fold != 2))
    rows = docs.select(
        "doc_id", "text", F.coalesce(fold == 2, F.lit(False)).alias("held_out"),
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"),
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        lambda batches: _predict(batches, model), f"doc_id {kind}, held_out boolean, lang_pred string, score double, ambiguous boolean"
    )


def op3_ecoc_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(read(spark, sf_dir, "documents"))
