"""Token ids packed into rows of one length, best fit decreasing.

Each task tokenises its documents and packs them in blocks of about ``BLOCK_TOKENS`` tokens: a document's ids
end with the end-of-text id, are split into pieces of at most ``seq_len`` (all but the last are full rows of
their own), and pieces go, longest first, into the open row with the least room that still holds them.  A
segment tree over room sizes finds that room in ``log2(seq_len)`` steps.

A packed row holds ``ids`` (int32, little endian, padded with the end-of-text id to ``seq_len``), ``cu_seqlens``
(0 and the end of each segment), ``positions`` (int32: counts from 0 in each segment, 0 in the padding), and for
each segment the document and the offset of its first token in that document, so that texts can be put
together again without loss.  Nothing is shuffled; a task that is run again reads the same rows and packs them
the same way.

Defined cases: a null or empty text has no tokens and no segment; repeated rows and null doc_ids are packed like
others; strings that look like special tokens are ordinary text; other columns are ignored; an empty table
gives no rows.  The vocabulary is read once by the driver (one or two MB) and sent to the tasks.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlens.llm.common import read
from meterlens.llm.textnum import slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_OF_TEXT = 50256
SEQ_LEN = 2048
BLOCK_TOKENS = 1 << 21
FIELDS = "ids binary, n_tokens int, cu_seqlens array<int>, positions binary, seg_docs array<{kind}>, seg_offsets array<long>"


class RoomTree:
    """Segment tree over room sizes 0 .. top: how many open rows have each room."""

    def __init__(self, top: int):
        self.leaves = 1 << top.bit_length()
        self.most = [-1] * (2 * self.leaves)  # largest room below each node, -1 if none
        self.rows: list[list[int]] = [[] for _ in range(top + 1)]

    def _set(self, room: int, value: int) -> None:
        node = room + self.leaves
        self.most[node] = value
        while node > 1:
            node >>= 1
            self.most[node] = max(self.most[2 * node], self.most[2 * node + 1])

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        if len(self.rows[room]) == 1:
            self._set(room, room)

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) of the open row with the least room of at least ``need``."""
        if self.most[1] < need:
            return None
        node = 1
        low, width = 0, self.leaves
        while width > 1:
            width >>= 1
            left = 2 * node
            # the left half holds a fitting room if its largest does
            node, low = (left, low) if self.most[left] >= need else (left + 1, low + width)
        row = self.rows[low].pop()
        if not self.rows[low]:
            self._set(low, -1)
        return low, row


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of piece numbers; every piece is at most ``capacity`` long.  Equal lengths go in their order."""
    tree, rows = RoomTree(capacity), []
    for piece in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        found = tree.take(lengths[piece])
        if found is None:
            room, row = capacity, len(rows)
            rows.append([])
        else:
            room, row = found
        rows[row].append(piece)
        if room > lengths[piece]:
            tree.add(room - lengths[piece], row)
    return rows


def _encoding(ranks: dict[bytes, int]):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def vocabulary(path: str = VOCABULARY) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _pack(batches: Iterator[pa.RecordBatch], ranks: bytes, seq_len: int, end: int, block_tokens: int) -> Iterator[pa.RecordBatch]:
    encode = _encoding({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}).encode_ordinary
    held: list[tuple[object, np.ndarray]] = []
    total = 0
    kind = None
    for batch in batches:
        kind = batch.schema.field("doc_id").type
        for part in slices(batch, "text", 1 << 20):
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                if not text:
                    continue
                ids = np.array([*encode(text), end], np.int32)
                held.append((doc_id, ids))
                total += len(ids)
                if total >= block_tokens:
                    yield _block(held, seq_len, end, kind)
                    held, total = [], 0
    if held:
        yield _block(held, seq_len, end, kind)


def _block(held: list, seq_len: int, end: int, kind: pa.DataType) -> pa.RecordBatch:
    pieces = [(doc_id, at, ids[at : at + seq_len]) for doc_id, ids in held for at in range(0, len(ids), seq_len)]
    rows = best_fit_decreasing([len(p[2]) for p in pieces], seq_len)
    matrix = np.full((len(rows), seq_len), end, "<i4")
    positions = np.zeros((len(rows), seq_len), "<i4")
    edges, docs, offsets = [], [], []
    for r, row in enumerate(rows):
        at, bounds = 0, [0]
        for k in row:
            ids = pieces[k][2]
            matrix[r, at : at + len(ids)] = ids
            positions[r, at : at + len(ids)] = np.arange(len(ids))
            at += len(ids)
            bounds.append(at)
        edges.append(bounds)
        docs.append([pieces[k][0] for k in row])
        offsets.append([pieces[k][1] for k in row])
    return pa.RecordBatch.from_arrays(
        [
            pa.array([x.tobytes() for x in matrix], pa.binary()), pa.array([b[-1] for b in edges], pa.int32()), pa.array(edges, pa.list_(pa.int32())),
            pa.array([x.tobytes() for x in positions], pa.binary()), pa.array(docs, pa.list_(kind)), pa.array(offsets, pa.list_(pa.int64())),
        ],
        ["ids", "n_tokens", "cu_seqlens", "positions", "seg_docs", "seg_offsets"],
    )


def packed(
    docs: DataFrame, path: str = VOCABULARY, seq_len: int = SEQ_LEN, end: int = END_OF_TEXT, block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """The packed rows of ``docs`` (doc_id, text)."""
    ranks = vocabulary(path)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lambda batches: _pack(batches, ranks, seq_len, end, block_tokens), FIELDS.format(kind=kind))


def unpacked(rows: DataFrame, path: str = VOCABULARY, end: int = END_OF_TEXT) -> DataFrame:
    """``doc_id, text`` of every packed document, for tests and audits: pieces are put together by document and offset.

    Documents must have distinct ids.
    """
    ranks = vocabulary(path)
    kind = rows.schema["seg_docs"].dataType.elementType.simpleString()
    segments = rows.select(
        "ids", F.posexplode("seg_docs").alias("k", "doc_id"), "seg_offsets", "cu_seqlens"
    ).select(
        "doc_id",
        F.get("seg_offsets", "k").alias("at"),
        F.expr("substring(ids, 4 * get(cu_seqlens, k) + 1, 4 * (get(cu_seqlens, k + 1) - get(cu_seqlens, k)))").alias("part"),
    )

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = _encoding({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}).decode
        for batch in batches:
            out = []
            for parts in batch.column("parts").to_pylist():
                ids = np.frombuffer(b"".join(p["part"] for p in parts), "<i4")
                assert ids[-1] == end
                out.append(decode(ids[:-1].tolist()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    whole = segments.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("at", "part"))).alias("parts"))
    return whole.mapInArrow(texts, f"doc_id {kind}, text string")


def op5_bfd_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read(spark, sf_dir, "documents"))
