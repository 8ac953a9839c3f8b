"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Tokens are runs of letters, digits and bytes outside ASCII, or runs of other printing characters; single tokens
and pairs of neighbours are hashed into ``BUCKETS`` buckets.  The target model counts all documents labelled good
(quality 1, not toxic), the raw model all documents.  A document's log weight is the sum of log(target/raw) over its
n-grams.  Adding Gumbel noise, seeded by its id, and keeping the k largest keys samples k documents without
replacement in proportion to their weights.  k is ``share`` of all documents, by default the share of labels with
quality 1.

Defined cases: a null or empty text has log weight 0; documents without a label count as raw only; of several
labels of one doc_id the worst holds; a null doc_id has no label and a noise of its own; repeated rows have equal keys
and where the k-th key is shared, rows that tie in key and id are all in or all out, so k may be missed by these (they are left out);
without good labels nothing is selected; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlens.llm.common import order_cut, read, staged
from meterlens.llm.textnum import PLACES, buffers, mixed, slices, word_hashes

BUCKETS = 10_000
SEED = 2
SMOOTH = 1.0

#: White space 0, letters, digits and bytes outside ASCII 1, the rest 2.
CLASSES = np.full(256, 2, np.uint8)
CLASSES[[9, 10, 11, 12, 13, 32]] = 0
CLASSES[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def _features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all n-grams, owner text of each)."""
    data, offsets = buffers(texts)
    tokens, counts = word_hashes(data, offsets, CLASSES)
    owner = np.repeat(np.arange(len(counts)), counts)
    pairs = mixed(tokens[:-1] * PLACES[0] + tokens[1:] * PLACES[1])
    whole = owner[1:] == owner[:-1]
    grams = np.concatenate([tokens, pairs[whole]])
    return (grams % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([owner, owner[1:][whole]])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for part in slices(batch, "text"):
            buckets, owner = _features(part.column("text"))
            good = np.asarray(part.column("good").to_numpy(zero_copy_only=False), bool)
            raw += np.bincount(buckets, minlength=BUCKETS)
            target += np.bincount(buckets[good[owner]], minlength=BUCKETS)
    some = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])


def good_ids(labels: DataFrame) -> DataFrame:
    """``doc_id, good`` of every labelled id."""
    worst = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    return worst.select("doc_id", ((F.coalesce("q", F.lit(0)) == 1) & (F.coalesce("t", F.lit(0)) == 0)).alias("good"))


def log_ratios(docs: DataFrame, good: DataFrame) -> np.ndarray:
    """log(target/raw) of every bucket; ``BUCKETS`` numbers, whatever the size of the corpus."""
    known = good.filter("good").select(F.col("doc_id").alias("g_id"), "good")
    # labels grow with the corpus: the same join at every size
    rows = docs.select("doc_id", "text").join(known.hint("merge"), F.col("doc_id") == F.col("g_id"), "left")
    counts = rows.select("text", F.coalesce("good", F.lit(False)).alias("good")).mapInArrow(_count, "bucket long, raw long, target long")
    found = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.full(BUCKETS, SMOOTH), np.full(BUCKETS, SMOOTH)
    for row in found:
        raw[row["bucket"]] += row["raw"]
        target[row["bucket"]] += row["target"]
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def _descending_hex(keys: np.ndarray) -> list[str]:
    """16 hex digits of each number, in descending order of the numbers."""
    bits = keys.astype(np.float64).view(np.uint64)
    ascending = np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))
    return [f"{x:016x}" for x in (~ascending).tolist()]


def _score(batches: Iterator[pa.RecordBatch], ratios: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            buckets, owner = _features(part.column("text"))
            weights = np.bincount(owner, weights=ratios[buckets], minlength=part.num_rows)
            noise = np.asarray(part.column("noise")).astype(np.int64).view(np.uint64) >> np.uint64(11)
            uniform = (noise.astype(np.float64) + 0.5) / 2.0**53
            keys = weights - np.log(-np.log(uniform))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(weights), pa.array(keys), pa.array(_descending_hex(keys))], ["doc_id", "log_weight", "key", "place"]
            )


def resampled(spark: SparkSession, docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = SEED) -> DataFrame:
    """``doc_id, log_weight, key, selected`` of every row of ``docs`` (doc_id, text)."""
    good = staged(spark, good_ids(labels), "good")
    ratios = log_ratios(docs, good)
    if share is None:
        share = labels.filter("doc_id is not null").agg(F.avg((F.coalesce("quality", F.lit(0)) == 1).cast("int"))).first()[0] or 0.0
    noise = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text", noise.alias("noise")).mapInArrow(
        lambda batches: _score(batches, ratios), f"doc_id {kind}, log_weight double, key double, place string"
    )
    # one group, each row counting once: written as columns, so that its joins stay joins by key
    scored = staged(spark, scored.withColumn("whole", F.lit(0)).withColumn("one", F.lit(1).cast("long")), "scored")
    # one row of known size, so that no join on the one group shuffles all rows to one task
    need = staged(spark, scored.groupBy("whole").agg(F.floor(F.count("*") * share + 0.5).cast("double").alias("need")), "need")
    cut = order_cut(scored, need, "whole", "place", "one", ["doc_id"], (3, 6, 9, 12))
    cut = cut.first()  # one row at most
    if cut is None:
        selected = F.lit(True)
    else:
        same = F.col("place") == cut["cut_digest"]
        if cut["cut_doc_id"] is None:  # nulls come first: none before it, all of them after the end of a cell
            before = F.lit(False)
        else:
            before = F.col("doc_id").isNull() | (F.col("doc_id") < F.lit(cut["cut_doc_id"]))
        selected = (F.col("place") < cut["cut_digest"]) | (same & before)
    return scored.select("doc_id", "log_weight", "key", selected.alias("selected"))


def op2_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
