"""Near-equal lines by a segment-partition edit join.

Two lines within ``THRESHOLD`` edits of each other: of the threshold + 1 segments of the one, at least one stands
unchanged in the other, near its own place.  Every distinct line enters an index under (its length, segment number,
segment hash) and probes the indexes of its own and up to threshold shorter lengths with the substrings that
can hold a segment (chosen so that a pair is still met when edits left and right of the segment are
counted).  Pairs that meet are verified by edit distance in a band of 2 * threshold + 1 diagonals, held in
the bits of one word and computed for many pairs at once.  Where many lines meet under one key (a passage with
many variants), they are dealt in blocks, a block pair is one task, and only links come out of it, never pairs.

Classes are the connected components of linked lines; of each class the first line, by document and place, is kept.

Lines of up to ``THRESHOLD`` code points have empty segments, under which they meet all lines of their length and up to
threshold more, so short lines are joined as any others are.

Defined cases: lines are split at line feeds, only lines with a word count, and are compared whole after white space at
either end is cut; a null text has no lines; null doc_ids come first; repeated rows have equal lines; other columns are ignored; an empty table gives
no rows.  Lines are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlens.llm.common import bind, components, read, staged
from meterlens.llm.textnum import BASE, mixed, slices

THRESHOLD = 2
MIN_CHARS = 1  # shorter lines would join only their equals
FILTER_BITS = 20
FRESH = 1 << 18  # lines remembered by a task before it forgets them
FEW = 64  # pairs of one key that are listed; more are tested in blocks
BLOCK = 256  # lines in a block, about


def document_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, line_no, line, line_id`` of every line with a word."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    rows = bind(rows, line=F.btrim("raw", F.lit(" \t\x0b\f\r")))
    return rows.filter("line != ''").select("doc_id", "line_no", "line", F.xxhash64("line").alias("line_id"))


def segments(length: int, threshold: int) -> list[tuple[int, int]]:
    """(start, length) of the threshold + 1 segments, the longer ones last."""
    parts = threshold + 1
    short, longer = length // parts, length % parts
    out, at = [], 0
    for i in range(parts):
        size = short + (i >= parts - longer)
        out.append((at, size))
        at += size
    return out


def probes(length: int, threshold: int) -> list[tuple[int, int, int, int]]:
    """(indexed length, segment number, start, size) of the substrings a line of ``length`` looks up.

    Those that equal its own index entries are left out: index entries meet each other anyway.
    """
    out = []
    for shorter in range(min(threshold, length - 1) + 1):  # there are no lines of length 0
        for i, (at, size) in enumerate(segments(length - shorter, threshold)):
            left, right = i, threshold - i
            low = max(0, at - left, at + shorter - right)
            high = min(length - size, at + left, at + shorter + right)
            out += [(length - shorter, i, start, size) for start in range(low, high + 1) if shorter or start != at]
    return out


def _fresh_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (line_id, line) once per task, or more often, where a task has very many."""
    seen: set[int] = set()
    for batch in batches:
        keep = []
        for k, line_id in enumerate(batch.column("line_id").to_pylist()):
            if line_id not in seen:
                seen.add(line_id)
                keep.append(k)
        if len(seen) > FRESH:
            seen.clear()
        yield batch.take(pa.array(keep, pa.int64()))


class _Powers:
    """Powers of the base and of its inverse, as many as were needed so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        if len(self.up) < n:
            inverse = pow(BASE, -1, 2**64)
            one = np.ones(1, np.uint64)
            self.up = np.cumprod(np.concatenate([one, np.full(n, BASE, np.uint64)]))
            self.down = np.cumprod(np.concatenate([one, np.full(n, inverse, np.uint64)]))


def _points(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(x) for x in lines], np.int64)
    return np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4"), lengths


def _keys(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """``key, line_id, entry``: index entries and probes of each line."""
    powers = _Powers()
    for whole in batches:
        for part in slices(whole, "line", 1 << 20):
            ids = np.asarray(part.column("line_id"))
            points, lengths = _points(part.column("line").to_pylist())
            starts = np.cumsum(lengths) - lengths
            powers.upto(len(points) + 1)
            sums = np.zeros(len(points) + 1, np.uint64)
            np.cumsum((points.astype(np.uint64) + np.uint64(1)) * powers.up[: len(points)], out=sums[1:])
            # lines of one length have their substrings at the same places
            order = np.argsort(lengths, kind="stable")
            edges = np.flatnonzero(np.diff(lengths[order])) + 1
            keys, owners, entries = [], [], []
            for rows in np.split(order, edges) if len(order) else []:
                length = int(lengths[rows[0]])
                own = [(length, i, at, size) for i, (at, size) in enumerate(segments(length, threshold))]
                spot = np.array(own + probes(length, threshold), np.int64)
                begin = starts[rows][:, None] + spot[None, :, 2]
                sub = (sums[begin + spot[None, :, 3]] - sums[begin]) * powers.down[begin]
                salt = mixed((spot[:, 0] * 64 + spot[:, 1]).astype(np.uint64))
                keys.append(mixed(sub ^ salt[None, :]).ravel())
                owners.append(np.repeat(ids[rows], len(spot)))
                entries.append(np.tile(np.arange(len(spot)) < len(own), len(rows)))
            if keys:
                columns = [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owners)), pa.array(np.concatenate(entries))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "line_id", "entry"])


def _met(batches: Iterator[pa.RecordBatch], few: int) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key: ``x, y, entry, hot``, pairs of line ids or, where a key has more, its rows (key, line, entry)."""
    key, line, entry = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    passed: set[int] = set()
    for batch in batches:
        key = np.append(key, np.asarray(batch.column("key")))
        line = np.append(line, np.asarray(batch.column("line_id")))
        entry = np.append(entry, np.asarray(batch.column("entry").to_numpy(zero_copy_only=False), bool))
        if not len(key):
            continue
        # the last key may go on; one with very many rows has them passed on as they come
        last = key[-1]
        done = int(np.searchsorted(key, last))
        if len(key) - done > FRESH or last in passed:
            passed = {last}
            done = len(key)
        yield _groups(key[:done], line[:done], entry[:done], few, passed)
        key, line, entry = key[done:], line[done:], entry[done:]
    yield _groups(key, line, entry, few, passed)


def _groups(key: np.ndarray, line: np.ndarray, entry: np.ndarray, few: int, passed: set[int]) -> pa.RecordBatch:
    heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(heads, len(key)))
    x, y, e, h = [], [], [], []
    some = np.flatnonzero((sizes > 1) | np.isin(key[heads], list(passed))) if len(key) else heads
    for at, size in zip(heads[some].tolist(), sizes[some].tolist(), strict=True):
        lines, which = np.unique(line[at : at + size], return_inverse=True)
        held = np.bincount(which, weights=entry[at : at + size]) > 0
        if key[at] not in passed and held.sum() * (len(lines) - 1) <= few:
            for p in np.flatnonzero(held).tolist():
                for q in range(len(lines)):
                    if q != p and not (held[q] and q < p):
                        x.append(min(lines[p], lines[q]))
                        y.append(max(lines[p], lines[q]))
                        e.append(False)
                        h.append(False)
        else:
            x += [key[at]] * size
            y += line[at : at + size].tolist()
            e += entry[at : at + size].tolist()
            h += [True] * size
    return pa.RecordBatch.from_arrays(
        [pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(e, pa.bool_()), pa.array(h, pa.bool_())], ["x", "y", "entry", "hot"]
    )


def _dealt(hot: DataFrame) -> DataFrame:
    """Rows of hot keys dealt to pairs of a block of entries and a block of any lines: ``key, i, j, probing, line_id, entry``."""
    sizes = hot.groupBy("key").agg(F.count("*").alias("n"), F.count_if("entry").alias("n_entry"))
    sizes = staged(hot.sparkSession, sizes, "line-hot-keys")
    rows = hot.join(sizes, "key")

    def block(n: str):
        return F.pmod(F.xxhash64("line_id"), F.ceil(F.col(n) / BLOCK)).cast("int")

    def every(n: str):
        return F.sequence(F.lit(0), F.ceil(F.col(n) / BLOCK).cast("int") - 1)

    def spot(i, j, probing: bool):
        return F.struct(i.alias("i"), j.alias("j"), F.lit(probing).alias("probing"))

    asking = F.transform(every("n_entry"), lambda i: spot(i, block("n"), True))
    indexed = F.when(F.col("entry"), F.transform(every("n"), lambda j: spot(block("n_entry"), j, False))).otherwise(F.array())
    return rows.filter("n_entry > 0").select("key", "line_id", "entry", F.inline(F.concat(asking, indexed)))


def _block_links(table: pa.Table, threshold: int) -> pa.Table:
    """Links between the entries of one block and the lines of another."""
    probing = np.asarray(table.column("probing").combine_chunks().to_numpy(zero_copy_only=False), bool)
    entry = np.asarray(table.column("entry").combine_chunks().to_numpy(zero_copy_only=False), bool)
    ids = np.asarray(table.column("line_id"))
    points, lengths = _points(_padded(table.column("line").to_pylist(), threshold))
    starts = np.cumsum(lengths) - lengths
    indexed, asking = np.flatnonzero(~probing), np.flatnonzero(probing)
    one, two = np.repeat(indexed, len(asking)), np.tile(asking, len(indexed))
    # two entries meet in both orders
    once = (ids[one] != ids[two]) & (~entry[two] | (ids[one] < ids[two]))
    one, two = one[once], two[once]
    far = _distances(points, starts[one], lengths[one], points, starts[two], lengths[two], threshold)
    one, two = ids[one[far <= threshold]], ids[two[far <= threshold]]
    return pa.table({"a": np.minimum(one, two), "b": np.maximum(one, two)})


def _padded(lines: list[str], threshold: int) -> list[str]:
    """Lines as they are or, if one is not longer than ``threshold``, all with the same end, which adds no edits."""
    if min(map(len, lines), default=threshold + 1) > threshold:
        return lines
    return [x + " " * threshold for x in lines]


def within(a: list[str], b: list[str], threshold: int) -> np.ndarray:
    """Edit distances of pairs of strings; threshold + 1 stands for all above it."""
    both = _padded(a + b, threshold)
    one, m = _points(both[: len(a)])
    two, n = _points(both[len(a) :])
    return _distances(one, np.cumsum(m) - m, m, two, np.cumsum(n) - n, n, threshold)


def _distances(
    one: np.ndarray, at_one: np.ndarray, m: np.ndarray, two: np.ndarray, at_two: np.ndarray, n: np.ndarray, threshold: int
) -> np.ndarray:
    """Distances of the strings of length ``m`` at ``at_one`` in ``one`` and of length ``n`` at ``at_two`` in ``two``.

    All of them are longer than ``threshold``.

    One word per pair holds the vertical differences in a band around the diagonal: bit 63 - d is row
    ``column + threshold - d`` of the first string.  The band follows the diagonal until it meets the last row,
    whose differences are then followed to the last column.
    """
    ones, bit = ~np.uint64(0), np.uint64(1)
    plus = np.full(len(m), ones << np.uint64(63 - threshold), np.uint64)
    minus = np.zeros(len(m), np.uint64)
    cost = np.full(len(m), threshold, np.int64)
    apart = np.abs(m - n) > threshold
    for column in range(int(n.max(initial=0))):
        live = np.flatnonzero((column < n) & ~apart)
        if not len(live):
            break
        symbol = two[at_two[live] + column]
        equal = np.zeros(len(live), np.uint64)
        for d in range(2 * threshold + 1):
            row = column + threshold - d
            if row < 0:
                continue
            there = row < m[live]
            hit = there & (one[at_one[live] + np.minimum(row, m[live] - 1)] == symbol)
            equal |= hit.astype(np.uint64) << np.uint64(63 - d)
        up, down = plus[live], minus[live]
        diagonal = (((equal & up) + up) ^ up) | equal | down
        rise = down | ~(diagonal | up)
        fall = diagonal & up
        below = column - (m[live] - threshold)  # columns since the band met the last row
        first = below < 0
        spot = np.uint64(62) - np.minimum(np.maximum(below, 0), 62).astype(np.uint64)
        change = ((rise >> spot) & bit).astype(np.int64) - ((fall >> spot) & bit).astype(np.int64)
        cost[live] += np.where(first, 1 - (diagonal >> np.uint64(63)).astype(np.int64), change)
        plus[live] = fall | ~((diagonal >> bit) | rise)
        minus[live] = (diagonal >> bit) & rise
        # only columns along the last row, one edit each, can lower the cost again
        apart[live] = cost[live] > threshold + np.minimum(n[live] - m[live] + threshold, n[live] - 1 - column)
    return np.where(apart | (cost > threshold), threshold + 1, cost)


def _verify(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for part in slices(whole, "line_a"):
            far = within(part.column("line_a").to_pylist(), part.column("line_b").to_pylist(), threshold)
            yield part.select(["a", "b"]).filter(pa.array(far <= threshold))


def linked_lines(spark: SparkSession, lines: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """Pairs (a < b) of the ids of different lines within ``threshold`` edits."""
    texts = lines.select("line_id", "line").filter(F.char_length("line") >= min_chars)
    shape = "line_id long, line string"
    once = texts.mapInArrow(_fresh_lines, shape).repartition("line_id").mapInArrow(_fresh_lines, shape)
    keys = once.mapInArrow(lambda batches: _keys(batches, threshold), "key long, line_id long, entry boolean")
    few = FEW
    met = keys.repartition("key").sortWithinPartitions("key").mapInArrow(lambda batches: _met(batches, few), "x long, y long, entry boolean, hot boolean")
    met = staged(spark, met, "line-met")
    pairs = staged(spark, met.filter("not hot").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "line-pairs")
    # a line can enter and probe under one key
    hot = met.filter("hot").groupBy(F.col("x").alias("key"), F.col("y").alias("line_id")).agg(F.max("entry").alias("entry"))
    hot = staged(spark, hot, "line-hot")
    # a million places at most stand for the ids in pairs: as a table of known size it is small enough to be
    # broadcast by Spark's own threshold, and most lines in no pair leave before their texts are shuffled
    ids = staged(spark, pairs.select(F.explode(F.array("a", "b")).alias("line_id")).union(hot.select("line_id")).distinct(), "line-ids")
    place = F.shiftrightunsigned("line_id", 64 - FILTER_BITS).cast("int")
    places = staged(spark, ids.select(place.alias("place")).distinct().coalesce(1), "line-places")
    wanted = texts.withColumn("place", place).join(places, "place", "left_semi").select("line_id", "line")
    wanted = wanted.mapInArrow(_fresh_lines, shape).groupBy("line_id").agg(F.max("line").alias("line"))
    wanted = staged(spark, wanted.join(ids, "line_id"), "line-texts")
    rows = pairs.join(wanted.select(F.col("line_id").alias("a"), F.col("line").alias("line_a")), "a")
    rows = rows.join(wanted.select(F.col("line_id").alias("b"), F.col("line").alias("line_b")), "b").select("a", "b", "line_a", "line_b")
    links = rows.mapInArrow(lambda batches: _verify(batches, threshold), "a long, b long")
    blocks = _dealt(hot).join(wanted, "line_id").groupBy("key", "i", "j")
    more = blocks.applyInArrow(lambda table: _block_links(table, threshold), "a long, b long")
    return staged(spark, links.union(more).distinct(), "line-links")


def line_classes(spark: SparkSession, docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, line_no, line_id, class_id, n_links, kept`` of every line of ``docs`` (doc_id, text).

    ``n_links`` counts the different lines it is linked with, ``class_id`` is the smallest line id of its class.
    """
    lines = document_lines(docs)
    links = linked_lines(spark, lines, threshold, min_chars)
    labels = components(spark, links)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    known = staged(spark, labels.join(degree, "node"), "line-classes")
    rows = lines.select("doc_id", "line_no", "line_id").join(known, F.col("line_id") == F.col("node"), "left")
    rows = rows.select(
        "doc_id", "line_no", "line_id", F.coalesce("label", "line_id").alias("class_id"), F.coalesce("links", F.lit(0).cast("long")).alias("n_links")
    )
    rows = staged(spark, rows, "lines")
    first = rows.groupBy("class_id").agg(F.min(F.struct("doc_id", "line_no")).alias("first"))
    first = staged(spark, first.withColumnRenamed("class_id", "c"), "line-firsts")
    rows = rows.join(first, F.col("class_id") == F.col("c"))
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("line_no") == F.col("first.line_no"))
    return rows.select("doc_id", "line_no", "line_id", "class_id", "n_links", kept.alias("kept"))


def op7_segment_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_classes(spark, read(spark, sf_dir, "documents"))
