"""Near-duplicates by min-max hashing: candidates from banded signatures, links confirmed on full shingle sets.

Under each of 64 permutations of the hashed five-word shingles both the smallest and the largest value are
kept: 128 signature values for 64 hash evaluations.  Four values (two permutations) make a band, 32 bands
in all, so a pair at similarity 0.75 shares no band with a chance of 5e-6.

Texts with equal sets form a class and only one of each class goes on.  Every band that several classes share names
one of them its pivot, the one that meets most others in all its bands: in a group of copies that is a text with
few edits.  Classes are first tested against the pivots of their bands, the most frequent one first, so a large
group of near copies falls into one component after tests in proportion to its size.  Two classes that share a
band share its pivot; where the classes of a pivot are then still in several components, those outside the
largest are tested against all others of that pivot.  That is done in blocks: a block pair is one task, counts common
shingles as a matrix product and returns only links that join components, never pairs.  Every test
compares full sets.

Defined cases: a null, empty or wordless text has no shingles, no links and is kept; the id of a component is
its smallest doc_id, nulls aside; rows with a null doc_id are kept only in components of such rows; repeated rows
are one class and get the same verdict; other columns are ignored.  Classes are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlens.llm.common import components, read, staged
from meterlens.llm.textnum import ASCII_LOWER, buffers, mixed, shingle_sets, slices, word_hashes

PERMUTATIONS = 64
BAND = 2  # permutations, two values each
BLOCK = 256  # classes, about, and shingles in a block
BLOCK_SHINGLES = 1 << 18

_draw = np.random.default_rng(75)
_FACTORS = _draw.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1)
_SALTS = _draw.integers(0, 2**64, PERMUTATIONS, dtype=np.uint64)
_SHIFTS = _draw.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes, start of each text's, number of each text's)."""
    data, offsets = buffers(texts)
    own, sizes = shingle_sets(*word_hashes(ASCII_LOWER[data], offsets))
    return own, np.cumsum(sizes) - sizes, sizes


def _totals(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            own, starts, sizes = shingles(part.column("text"))
            some = np.flatnonzero(sizes)
            node = np.zeros(len(sizes), np.int64)
            bands = np.zeros((len(sizes), PERMUTATIONS // BAND), np.uint64)
            if len(some):
                at = starts[some]
                node[some] = mixed(_totals(mixed(own ^ np.uint64(0x5851F42D4C957F2D)), at) + sizes[some].astype(np.uint64)).view(np.int64)
                short = (own >> np.uint64(32)).astype(np.uint32)
                band = np.zeros((len(some), PERMUTATIONS // BAND), np.uint64)
                for j in range(PERMUTATIONS):
                    moved = short * _FACTORS[j] + _SHIFTS[j]
                    both = np.minimum.reduceat(moved, at).astype(np.uint64) << np.uint64(32) | np.maximum.reduceat(moved, at)
                    k = j // BAND
                    band[:, k] = mixed(band[:, k] ^ (both + _SALTS[j]))
                bands[some] = band
            lists = pa.ListArray.from_arrays(
                np.arange(len(sizes) + 1, dtype=np.int32) * bands.shape[1], pa.array(bands.view(np.int64).ravel())
            )
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_hash"), pa.array(node), pa.array(sizes), lists],
                ["doc_id", "text_hash", "node", "n_shingles", "bands"],
            )


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")


def signatures(docs: DataFrame) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _keyed(docs).mapInArrow(
        _signatures,
        f"doc_id {kind}, text_hash long, node long, n_shingles long, bands array<long>",
    )


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, text_a, text_b) the pairs whose sets have 100 * common >= 75 * union."""
    for batch in batches:
        for part in slices(batch, "text_a", 1 << 20):
            one, at_one, n_one = shingles(part.column("text_a"))
            texts_b = part.column("text_b").dictionary_encode()  # a pivot comes in runs
            two, at_two, n_two = shingles(texts_b.dictionary)
            which = np.asarray(texts_b.indices)
            linked = np.zeros(part.num_rows, bool)
            for k in range(part.num_rows):
                w = which[k]
                x, y = one[at_one[k] : at_one[k] + n_one[k]], two[at_two[w] : at_two[w] + n_two[w]]
                if 4 * min(len(x), len(y)) < 3 * max(len(x), len(y)):
                    continue
                common = len(x) + len(y) - len(np.union1d(x, y))
                linked[k] = 100 * common >= 75 * (len(x) + len(y) - common)
            yield part.select(["a", "b"]).filter(pa.array(linked))


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of ``pairs`` that are linked; ``texts`` has (node, text)."""
    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    rows = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return rows.select("a", "b", "text_a", "text_b").mapInArrow(_links, "a long, b long")


def _with_label(rows: DataFrame, labels: DataFrame, node: str, label: str) -> DataFrame:
    known = labels.select(F.col("node").alias("l_node"), F.col("label").alias("l_label"))
    return rows.join(known, F.col(node) == F.col("l_node"), "left").withColumn(label, F.coalesce("l_label", node)).drop("l_node", "l_label")


def _block_rows(spark: SparkSession, held: DataFrame) -> DataFrame:
    """Rows (pivot, node, label) dealt to the block pairs in which they are tested.

    Classes outside the largest component of a pivot make blocks that meet each other (kind 0, i <= j) and every
    block of that component (kind 1).
    """
    parts = held.groupBy("pivot", "label").agg(F.count("*").alias("size"), F.sum("n").alias("weight"))
    apart = parts.groupBy("pivot").agg(
        F.count("*").alias("labels"), F.sum("size").alias("size"), F.sum("weight").alias("weight"), F.max(F.struct("size", "weight", "label")).alias("top")
    )

    def blocks(size, weight):
        return F.greatest(F.ceil(size / BLOCK), F.ceil(weight / BLOCK_SHINGLES), F.lit(1)).cast("int")

    apart = apart.filter("labels > 1").select(
        "pivot", F.col("top.label").alias("top"),
        blocks(F.col("size") - F.col("top.size"), F.col("weight") - F.col("top.weight")).alias("few"),
        blocks(F.col("top.size"), F.col("top.weight")).alias("many"),
    )
    # one row per pivot: as a table of known size it is broadcast, or a hot pivot's classes are split by the join
    apart = staged(spark, apart, "pivots-apart")
    rows = held.join(apart, "pivot").withColumn("inside", F.col("label") == F.col("top"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("inside"), F.col("many")).otherwise(F.col("few"))).cast("int"))

    def key(kind, i, j):
        return F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"))

    own, few, many = F.col("own"), F.sequence(F.lit(0), F.col("few") - 1), F.sequence(F.lit(0), F.col("many") - 1)
    each_other = F.transform(few, lambda k: key(0, F.least(k, own), F.greatest(k, own)))
    keys = F.when(F.col("inside"), F.transform(few, lambda k: key(1, k, own))).otherwise(
        F.concat(each_other, F.transform(many, lambda k: key(1, own, k)))
    )
    return rows.select("pivot", "node", "label", "inside", "own", F.inline(keys))


def _common(x: tuple, y: tuple) -> np.ndarray:
    """Numbers of common shingles of each text of ``x`` with each of ``y``, as a matrix product over shared shingles."""
    (one, _, n_one), (two, _, n_two) = x, y
    shared = np.intersect1d(one, two)
    out = np.zeros((len(n_one), len(n_two)), np.float32)
    row_one, row_two = np.repeat(np.arange(len(n_one)), n_one), np.repeat(np.arange(len(n_two)), n_two)
    for lo in range(0, len(shared), 4096):
        part = shared[lo : lo + 4096]
        sides = []
        for values, rows, n in ((one, row_one, len(n_one)), (two, row_two, len(n_two))):
            at = np.minimum(np.searchsorted(part, values), len(part) - 1)
            hit = part[at] == values
            side = np.zeros((n, len(part)), np.float32)
            side[rows[hit], at[hit]] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out


def _block_links(table: pa.Table) -> pa.Table:
    """Of a block pair, links between components, as many as join them."""
    kind, i, j = (table.column(c)[0].as_py() for c in ("kind", "i", "j"))
    inside, own = np.asarray(table.column("inside")), np.asarray(table.column("own"))
    left, right = (np.flatnonzero(~inside), np.flatnonzero(inside)) if kind else (np.flatnonzero(own == i), np.flatnonzero(own == j))
    a_out: list[int] = []
    b_out: list[int] = []
    if len(left) and len(right):
        nodes, labels = np.asarray(table.column("node")), np.asarray(table.column("label"))
        texts = table.column("text").combine_chunks()
        x, y = shingles(texts.take(pa.array(left))), shingles(texts.take(pa.array(right)))
        common = _common(x, y).astype(np.int64)
        linked = 100 * common >= 75 * (x[2][:, None] + y[2][None, :] - common)
        linked &= labels[left][:, None] != labels[right][None, :]
        known: dict[int, int] = {}

        def head(k: int) -> int:
            while known.setdefault(k, k) != k:
                k = known[k]
            return k

        for p, q in np.argwhere(linked).tolist():
            one, two = head(int(labels[left[p]])), head(int(labels[right[q]]))
            if one != two:
                known[one] = two
                a_out.append(int(nodes[left[p]]))
                b_out.append(int(nodes[right[q]]))
    return pa.table({"a": pa.array(a_out, pa.int64()), "b": pa.array(b_out, pa.int64())})


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, n_shingles, component_id, kept`` of every row of ``docs`` (doc_id, text)."""
    signed = staged(spark, signatures(docs), "signatures")
    classes = signed.filter("n_shingles > 0").groupBy("node").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("rep"),
        F.min("doc_id").alias("least_id"),
        F.first("n_shingles").alias("n"),
        F.first("bands").alias("bands"),
    )
    classes = staged(spark, classes, "classes")

    banded = classes.select("node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("held")).filter("held > 1")
    members = staged(spark, banded.join(shared, "band"), "members")
    met = members.groupBy("node").agg(F.sum("held").alias("met"))
    pivots = members.join(met, "node").groupBy("band").agg(F.max(F.struct("met", "node")).alias("pivot"))
    pairs = members.join(pivots.select("band", F.col("pivot.node").alias("pivot")), "band").groupBy("node", "pivot")
    pairs = staged(spark, pairs.agg(F.count("*").alias("bands")), "pivots")

    touched = pairs.select("node").distinct().join(classes.select("node", "rep"), "node")
    texts = _keyed(docs)
    same = texts["doc_id"].eqNullSafe(F.col("rep.doc_id")) & (texts["text_hash"] == F.col("rep.text_hash"))
    texts = staged(spark, touched.join(texts, same).select("node", "text"), "texts")

    # against the pivot of most of a class's bands
    pairs = pairs.filter("node != pivot")
    first = pairs.groupBy("node").agg(F.max(F.struct("bands", "pivot")).alias("best"))
    first = staged(spark, first.select(F.col("node").alias("a"), F.col("best.pivot").alias("b")), "first")
    links = staged(spark, confirmed(first, texts), "links-1")
    labels = components(spark, links)

    # against the other pivots, where that can still join components
    rest = pairs.select(F.col("node").alias("a"), F.col("pivot").alias("b")).join(first, ["a", "b"], "left_anti")
    rest = _with_label(_with_label(rest, labels, "a", "label_a"), labels, "b", "label_b").filter("label_a != label_b")
    links = links.union(staged(spark, confirmed(staged(spark, rest.select("a", "b"), "rest"), texts), "links-2"))
    labels = components(spark, links)

    # what shares a pivot and is still apart
    held = _with_label(pairs, labels, "node", "label").join(classes.select("node", "n"), "node")
    held = staged(spark, held.select("pivot", "node", "label", "n"), "apart")
    last = staged(spark, _block_rows(spark, held).join(texts, "node").groupBy("pivot", "kind", "i", "j").applyInArrow(_block_links, "a long, b long"), "links-3")
    if not last.isEmpty():
        labels = components(spark, links.union(last))

    named = _with_label(classes.select("node", "least_id"), labels, "node", "component")
    least = named.groupBy("component").agg(F.min("least_id").alias("id"))
    named = named.select(F.col("node").alias("c_node"), "component").join(least, "component")
    rows = signed.select("doc_id", "text_hash", "n_shingles", "node").join(
        named, (F.col("n_shingles") > 0) & (F.col("node") == F.col("c_node")), "left"
    )
    component_id = F.when(F.col("n_shingles") > 0, F.col("id")).otherwise(F.col("doc_id"))
    rows = rows.withColumn("component_id", component_id).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    return rows.select("doc_id", "text_hash", "n_shingles", "component", "component_id", "kept")


def deduplicated(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row of each component: that of its smallest doc_id; of several such rows, that of the smallest text hash."""
    kept = near_duplicates(spark, docs).filter("kept")
    linked = kept.filter("n_shingles > 0").groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("one"), F.count("*").alias("m_rows"))
    bare = kept.filter("n_shingles = 0").select(F.col("doc_id").alias("m_id"), F.col("text_hash").alias("m_text")).distinct()
    chosen = linked.select(F.col("one.doc_id").alias("m_id"), F.col("one.text_hash").alias("m_text"), "m_rows").unionByName(
        bare.withColumn("m_rows", F.lit(1).cast("long"))
    )
    rows = docs.withColumn("m_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = rows.join(chosen, rows["doc_id"].eqNullSafe(F.col("m_id")) & (F.col("m_hash") == F.col("m_text")))
    # rows repeated whole: few, and only their components are looked at again
    again = rows.filter("m_rows > 1").dropDuplicates(["doc_id", "m_hash"])
    return rows.filter("m_rows = 1").unionByName(again).select(*docs.columns)


def op9_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")
