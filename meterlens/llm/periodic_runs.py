"""Periodic runs of words, found by a suffix automaton with link-cut access.

A run is a stretch of consecutive words with smallest period q and at least ``max(24, 3 q)`` words that no
neighbouring word extends.  The states of a suffix automaton are sets of repeated stretches, its suffix links a tree.
Words are appended one after the other; each recolours the path from the state of the whole text so far to the root
with its own place, so a state's colour is where its stretches last ended.  Preferred paths of one colour are kept in
splay trees (link-cut access), so a word meets few of them, on average a logarithm.  A path that ended ``d`` words ago
and whose longest stretch has ``n >= d`` words is a square: the last ``n + d`` words have period d, and no more of
them do.  Squares of one period and start belong to one run, whose end is that of the last.

A word of a run also stands in 16 words that come again one period later, because at least two thirds of a run,
so 16 words, do.  The automaton is therefore built over the stretches in which each 16 words come again near enough,
found from sorted hashes of all words; elsewhere no run can be.  Hashes only choose stretches, words are compared by
their bytes.  One narrow pass, no shuffle; memory of a task is a few hundred bytes for each word of such a stretch.

Defined cases: a null, empty or wordless text has no run, collapses to an empty text, and its document stays; each
of repeated rows and of documents with null ids gets its own result; ties of runs are ordered by start, then period;
an empty table gives no rows.  Other columns are carried only if named in ``keep``, which must name none of the new
ones (ValueError).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlens.llm.common import read, words
from meterlens.llm.textnum import buffers, mixed, slices, word_hashes

LEAST_WORDS = 24
LEAST_PERIODS = 3
#: Words of a run that come again, at the least: what is left of it without one period.
REPEATED = LEAST_WORDS - LEAST_WORDS // LEAST_PERIODS
NEW = ("n_words", "runs", "collapsed")


class SuffixTree:
    """Suffix automaton of a list of symbols: suffix links and longest lengths of states, and the state of each prefix."""

    def __init__(self, symbols: list[int]):
        self.link, self.length = [-1], [0]
        self.prefix: list[int] = []
        link, length = self.link, self.length
        step: list[dict[int, int]] = [{}]
        last = 0
        for symbol in symbols:
            new = len(link)
            link.append(0)
            length.append(length[last] + 1)
            step.append({})
            at = last
            while at >= 0 and symbol not in step[at]:
                step[at][symbol] = new
                at = link[at]
            if at >= 0:
                to = step[at][symbol]
                if length[to] == length[at] + 1:
                    link[new] = to
                else:
                    clone = len(link)
                    link.append(link[to])
                    length.append(length[at] + 1)
                    step.append(step[to].copy())
                    while at >= 0 and step[at].get(symbol) == to:
                        step[at][symbol] = clone
                        at = link[at]
                    link[to] = link[new] = clone
            self.prefix.append(new)
            last = new


class PreferredPaths:
    """Link-cut access over a fixed tree: preferred paths as splay trees by depth, one colour for each path."""

    def __init__(self, parent: list[int]):
        self.up = list(parent)  # parent in the splay tree, or of the path where no child points back
        self.left = [-1] * len(parent)
        self.right = [-1] * len(parent)
        self.colour = [-1] * len(parent)  # of the path, held by the root of its splay tree

    def _rotate(self, x: int, y: int) -> None:
        up, left, right = self.up, self.left, self.right
        z = up[y]
        if left[y] == x:
            inner = left[y] = right[x]
            right[x] = y
        else:
            inner = right[y] = left[x]
            left[x] = y
        if inner >= 0:
            up[inner] = y
        if z >= 0:
            if left[z] == y:
                left[z] = x
            elif right[z] == y:
                right[z] = x
        up[x], up[y] = z, x

    def _splay(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        former = x
        while (y := up[x]) >= 0 and (left[y] == x or right[y] == x):
            former, z = y, up[y]
            if z >= 0 and (left[z] == y or right[z] == y):
                former = z
                if (left[z] == y) == (left[y] == x):
                    self._rotate(y, z)
                else:
                    self._rotate(x, y)
            self._rotate(x, up[x])
        self.colour[x] = self.colour[former]

    def access(self, x: int, colour: int) -> list[tuple[int, int]]:
        """Recolour the path from ``x`` to the root; (lowest state, colour) of each old path on it, from below."""
        first, met, below = x, [], -1
        while x >= 0:
            self._splay(x)
            cut = self.right[x]
            if cut >= 0:
                self.colour[cut] = self.colour[x]
            self.right[x] = below
            met.append((x, self.colour[x]))
            below, x = x, self.up[x]
        self._splay(first)
        self.colour[first] = colour
        return met


def runs_of(symbols: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a list of symbols, by start, then period."""
    tree = SuffixTree(symbols)
    paths = PreferredPaths(tree.link)
    found: dict[tuple[int, int], int] = {}
    for place, state in enumerate(tree.prefix):
        for low, ended in paths.access(state, place):
            period, again = place - ended, tree.length[low]
            if ended >= 0 and again >= (LEAST_PERIODS - 1) * period and again + period >= LEAST_WORDS:
                found[place - period - again + 1, period] = place
    return sorted((start, last - start + 1, period) for (start, period), last in found.items())


def _covered(good: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the stretches of words that lie in windows starting at ``good``."""
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, good, 1)
    np.add.at(edge, good + REPEATED, -1)
    inside = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    return turns[::2], turns[1::2]


def stretches(hashes: np.ndarray, counts: np.ndarray) -> list[tuple[int, int]]:
    """Stretches [from, to) of the words of all texts outside of which there is no run."""
    total = len(hashes)
    if total < LEAST_WORDS:
        return []
    ends = np.cumsum(counts)
    owner = np.repeat(np.arange(len(counts)), counts)
    window, size = hashes, 1
    while size < REPEATED:  # a power of two
        window = mixed(window[:-size] * np.uint64(0x9E3779B97F4A7C15) + window[size:])
        size *= 2
    starts = np.flatnonzero(owner[: total - REPEATED + 1] == owner[REPEATED - 1 :])
    keys = window[starts] ^ mixed(owner[starts].astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys, kind="stable")
    keys, places = keys[order], starts[order]
    gap = np.where(keys[1:] == keys[:-1], places[1:] - places[:-1], total)
    near = np.full(total, total, np.int64)
    near[places[1:]] = gap
    near[places[:-1]] = np.minimum(near[places[:-1]], gap)
    good = starts[near[starts] * LEAST_PERIODS <= counts[owner[starts]]]
    todo, done = list(zip(*_covered(good, total), strict=True)), []
    while todo:
        first, end = todo.pop()
        for edge in ends[np.searchsorted(ends, first, side="right") :]:  # texts that touch are taken apart
            if edge >= end:
                break
            todo.append((edge, end))
            end = edge
            break
        if end - first < LEAST_WORDS:
            continue
        near_enough = first + np.flatnonzero(near[first : end - REPEATED + 1] * LEAST_PERIODS <= end - first)
        low, high = _covered(near_enough - first, end - first)
        parts = [(first + a, first + b) for a, b in zip(low, high, strict=True)]
        if parts == [(first, end)]:
            done.append((int(first), int(end)))
        else:
            todo.extend(parts)
    return done


def _collapsed(tokens: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if not runs:
        return b" ".join(tokens)
    keep = np.ones(len(tokens), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([tokens[k] for k in np.flatnonzero(keep)])


def _runs(batches: Iterator[pa.RecordBatch], keep: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "_text", 1 << 20):
            column = part.column("_text")
            data, offsets = buffers(column)
            hashes, counts = word_hashes(data, offsets)
            ends = np.cumsum(counts)
            found: dict[int, list[tuple[int, int]]] = {}
            for first, end in stretches(hashes, counts):
                found.setdefault(int(np.searchsorted(ends, first, side="right")), []).append((first, end))
            every, collapsed = [], []
            for row in range(part.num_rows):
                tokens = bytes(data[offsets[row] : offsets[row + 1]]).split()
                base, runs = int(ends[row] - counts[row]), []
                for first, end in sorted(found.get(row, [])):
                    number: dict[bytes, int] = {}
                    symbols = [number.setdefault(t, len(number)) for t in tokens[first - base : end - base]]
                    runs += [(first - base + start, length, period) for start, length, period in runs_of(symbols)]
                every.append([dict(zip(("start", "length", "period"), run, strict=True)) for run in runs])
                collapsed.append(_collapsed(tokens, runs))
            new = [pa.array(counts, pa.int64()), pa.array(every, schema.field("runs").type), pa.array(collapsed, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keep))), *new], [*keep, *NEW])


def periodic_runs(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep..., n_words, runs, collapsed``: the runs of every whole ``text``, and its words outside their repetitions.

    ``runs`` holds (start, length, period) by start, then period, in words from 0.  ``collapsed`` joins by one blank
    the words that no run contains behind its first period.
    """
    if set(keep) & set(NEW):
        raise ValueError(f"a kept column may not be named {', '.join(NEW)}")
    kept = "".join(f"`{k}` {docs.schema[k].dataType.simpleString()}, " for k in keep)
    run = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))
    schema = pa.schema([("runs", run)])
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(
        lambda batches: _runs(batches, list(keep), schema),
        f"{kept}n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string",
    )


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: the tail of a tenth of the texts, chosen by the checksum of their id, repeats its beginning."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, words(F.col("text"))).alias("w"), F.floor(h / 10).alias("g"))
    rows = rows.withColumn("n", F.size("w").cast("long"))
    rows = rows.withColumn("a", F.col("g") % F.greatest(F.col("n"), F.lit(1)))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))

    def place(i: Column) -> Column:
        return F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")

    again = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get("w", place(i))), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic_runs(planted(read(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id")
    # the first of the greatest exact exponents, runs being in the order of ties
    higher = lambda best, run: F.when(best.isNull() | (run.length * best.period > best.length * run.period), run).otherwise(best)
    best = F.aggregate("runs", F.get("runs", F.lit(0)), higher)
    line = lambda run: F.concat_ws(",", run.start, run.length, run.period)
    listed = F.array_join(F.transform("runs", lambda run: F.concat(line(run), F.lit("\n"))), "")
    rows = rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), listed.alias("listed"), "collapsed")
    return rows.select(
        "doc_id",
        "n_runs",
        "best.start",
        "best.length",
        "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
