"""Alignment of two tokenizers over the same bytes, by merge-path partitioning.

Side A is a byte-level tokenizer, side B a SentencePiece model; both read a blank and the text.  The byte offsets at
which tokens end are two sorted lists; where they share an offset a group ends, and the two tokens that end there
are linked.  A text of at most ``LONG_BYTES`` is merged at once, together with others of its batch.  The merge of a
longer one is cut along diagonals: a binary search finds for every ``PIECE_STEPS``-th step how many ends of each side
come before it, so pieces have equal work and know nothing of each other; Spark deals them out by (text, piece).  Each
emits the overlaps of its tokens and the groups that end in it; what is open at its ends is stitched per text.

In front of a blank behind a character that is no white space, tokens of both sides always end: side A's pattern matches none
across, and no piece of side B has a blank behind another character (else texts stay whole).  Short texts are cut
there, and of equal parts of a batch one is encoded; the different parts are merged, one behind the other, in pieces
as above.

Ids that are linked end alike, so the bytes of one are a suffix of the other's.  The vocabularies thus bound the
number of id pairs, whatever the corpus (about half a million for the default ones, see ``Pairs``): pairs have fixed
numbers, their counts over the corpus are one small table that goes through the driver back to the tasks.

Side A is encoded from the entries of its file with tiktoken, whose results are those of the file's own library
(tested); the file's merges must be in the order of its ids (ValueError).

Defined cases: a null or empty text, and one whose tokens of either side do not join to blank + text (a literal
U+2581, say), has no tokens: zeros, an empty list of groups.  Strings of special tokens are ordinary text.  Each of
repeated rows counts and gets its own row; null ids of documents are kept; ties among counts are all best; an empty
table gives no rows.  Other columns are carried only if named in ``keep``, which must name none of the new ones
(ValueError).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlens.llm.common import read, small_batches, staged
from meterlens.llm.packing import _encoding, vocabulary
from meterlens.llm.piece_codec import BLANK, MODEL
from meterlens.llm.textnum import equal_parts, slices

BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"
LONG_BYTES = 1 << 16
PIECE_STEPS = 1 << 14
#: Parts that side B encodes together.
RUN = 128
#: Links whose counts are looked up together.
RUN_LINKS = 1 << 17
NEW = ("n_a", "n_b", "n_groups", "groups", "links")
FIELDS = "n_a long, n_b long, n_groups long, groups string, links array<int>"


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else one from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(others)}


def side_a(file: bytes) -> list[bytes]:
    """The bytes of each id of a byte-level tokenizer file; special tokens have none."""
    content = json.loads(file)
    letters = _byte_letters()
    special = {entry["id"] for entry in content.get("added_tokens", [])}
    entries = content["model"]["vocab"]
    out = [b""] * (1 + max(entries.values()))
    for token, k in entries.items():
        if k not in special:
            out[k] = bytes(letters[c] for c in token)
    for rank, merge in enumerate(content["model"]["merges"]):
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        if entries[left + right] != 256 + rank:
            raise ValueError("merges are not in the order of their ids")
    return out


def side_b(model: bytes) -> list[bytes]:
    """The bytes of each id of a SentencePiece model inside a text; control ids have none."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    out = []
    for k in range(library.get_piece_size()):
        piece = library.id_to_piece(k)
        if library.is_byte(k):
            out.append(bytes([int(piece[3:5], 16)]))
        else:
            out.append(b"" if library.is_control(k) or library.is_unknown(k) else piece.replace("▁", " ").encode())
    return out


class Pairs:
    """Numbers of all id pairs of which one's bytes are a suffix of the other's."""

    def __init__(self, a: list[bytes], b: list[bytes]):
        self.width = len(b)
        found = []
        for short, long, key in ((b, a, lambda s, g: g * len(b) + s), (a, b, lambda s, g: s * len(b) + g)):
            ids: dict[bytes, list[int]] = {}
            for k, x in enumerate(short):
                if x:
                    ids.setdefault(x, []).append(k)
            for k, x in enumerate(long):
                for at in range(len(x)):
                    found.extend(key(s, k) for s in ids.get(x[at:], ()))
        self.keys = np.unique(np.array(found, np.int64))

    def numbers(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, a.astype(np.int64) * self.width + b)


@dataclass
class Piece:
    """A stretch of the merge of one or more texts: the tokens whose ends it meets, and how many come before them."""

    a_ids: np.ndarray
    a_ends: np.ndarray
    b_ids: np.ndarray
    b_ends: np.ndarray
    a_from: int = 0
    b_from: int = 0
    a_before: int = -1  # where the A token before the piece ends
    a_before_id: int = -1

    def overlaps(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(A token, B token, both end here) for each step of the merge; equal ends are one step, that of A."""
        b_of_a = np.searchsorted(self.b_ends, self.a_ends)
        a_of_b = np.searchsorted(self.a_ends, self.b_ends)
        both_a = np.append(self.b_ends, -1)[b_of_a] == self.a_ends
        both_b = np.append(self.a_ends, -2)[a_of_b] == self.b_ends
        a = np.concatenate([np.arange(len(self.a_ends)), a_of_b[~both_b]])
        b = np.concatenate([b_of_a, np.flatnonzero(~both_b)])
        closed = np.concatenate([both_a, np.zeros(len(self.b_ends) - both_b.sum(), bool)])
        if len(self.b_ends) and self.b_ends[0] == self.a_before:  # the A token that ends here was met by the piece before
            first = len(self.a_ends) + 0
            a[first], closed[first] = -1, True
        order = np.lexsort((b, a))
        return a[order], b[order], closed[order]


def merge_path(a_ends: np.ndarray, b_ends: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """How many ends of each side lie before every ``steps``-th step of their merge, A first among equals."""
    n, m = len(a_ends), len(b_ends)
    diagonal = np.append(np.arange(0, n + m, steps), n + m)
    low, high = np.maximum(0, diagonal - m), np.minimum(diagonal, n)
    while (open_ := low < high).any():
        middle = (low + high) // 2
        a_first = np.zeros(len(diagonal), bool)
        a_first[open_] = a_ends[middle[open_]] <= b_ends[(diagonal - 1 - middle)[open_]]
        low = np.where(open_ & a_first, middle + 1, low)
        high = np.where(open_ & ~a_first, middle, high)
    return low, diagonal - low


def cut(a_ids: np.ndarray, a_ends: np.ndarray, b_ids: np.ndarray, b_ends: np.ndarray, steps: int) -> list[Piece]:
    i, j = merge_path(a_ends, b_ends, steps)
    return [
        Piece(a_ids[p:q], a_ends[p:q], b_ids[r:s], b_ends[r:s], int(p), int(r), int(a_ends[p - 1]) if p else -1, int(a_ids[p - 1]) if p else -1)
        for p, q, r, s in zip(i, i[1:], j, j[1:], strict=False)
    ]


class Aligner:
    """Vocabularies, written ids and pair numbers of both sides."""

    def __init__(self, file: bytes, model: bytes, keys: np.ndarray):
        import sentencepiece

        self.a, self.b = side_a(file), side_b(model)
        self._encode_a = _encoding({x: k for k, x in enumerate(self.a) if x}).encode_ordinary
        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self._encode_b = library.encode
        # what the library gives no ids for: a blank in front of nothing
        self._blank = [library.piece_to_id(BLANK)]
        self._uncut = any(b" " in x.lstrip(b" ") for x in self.b)
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in side], np.int64) for side in (self.a, self.b))
        self.pairs = Pairs.__new__(Pairs)
        self.pairs.width, self.pairs.keys = len(self.b), keys
        # an id as it is written inside a group and at the end of its side
        self._written = np.array(
            [f"{k}{mark}" for k in range(len(self.a)) for mark in ",|"] + [f"{k}{mark}" for k in range(len(self.b)) for mark in ",;"], object
        )

    def tokens(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both sides, none where the tokens of a side do not give blank + text again."""
        nothing = np.zeros(0, np.int64)
        out = []
        for text, b_ids in zip(texts, self._encode_b([t or "" for t in texts], num_threads=1), strict=True):
            a_ids = self._encode_a(" " + text) if text else []
            whole = (" " + (text or "")).encode()
            if text and b"".join([self.b[k] for k in b_ids]) == whole and b"".join([self.a[k] for k in a_ids]) == whole:
                out.append((np.array(a_ids, np.int64), np.array(b_ids, np.int64)))
            else:
                out.append((nothing, nothing))
        return out

    def learn(self, parts: list[str], steps: int) -> "Parts":
        """What parts have that are encoded one behind the other.  None but a single one may end in white space."""
        text, sizes = "".join(parts), np.array([len(part.encode()) for part in parts], np.int64)
        whole = text.encode()
        a_ids = np.array(self._encode_a(text), np.int64)
        # the library's time grows faster than its text
        runs = ["".join(parts[k : k + RUN])[1:] for k in range(0, len(parts), RUN)]
        b_ids = np.array(list(chain.from_iterable(self._encode_b(runs, num_threads=1))) or self._blank, np.int64)
        if not (b"".join([self.b[k] for k in b_ids.tolist()]) == whole == b"".join([self.a[k] for k in a_ids.tolist()])):
            if len(parts) > 1:
                return Parts.joined([self.learn([part], steps) for part in parts])
            return Parts(*np.zeros((3, 1), np.int64), [""], np.zeros(0, np.int32), np.array([False]))
        a_ends, b_ends, upto = np.cumsum(self.a_sizes[a_ids]), np.cumsum(self.b_sizes[b_ids]), np.cumsum(sizes)
        links, a_cuts, b_cuts = [], [], []
        for piece in cut(a_ids, a_ends, b_ids, b_ends, steps):
            a, b, closed = piece.overlaps()
            links.append(self.links(piece, a[closed], b[closed]))
            a_cuts.append(a[closed] + 1 + piece.a_from)
            b_cuts.append(b[closed] + 1 + piece.b_from)
        links, a_cuts, b_cuts = (np.concatenate(x) for x in (links, a_cuts, b_cuts))
        written = self.written(a_ids, b_ids, a_cuts, b_cuts)
        a_upto, b_upto, g_upto = (np.searchsorted(ends, upto, side="right") for ends in (a_ends, b_ends, a_ends[a_cuts - 1]))
        last = (a_upto + b_upto).tolist()
        groups = ["".join(written[i:j])[:-1] for i, j in zip([0, *last], last, strict=False)]
        n_a, n_b, n_groups = (np.diff(x, prepend=0) for x in (a_upto, b_upto, g_upto))
        return Parts(n_a, n_b, n_groups, groups, links, np.ones(len(parts), bool))

    def texts(self, texts: list[str | None], steps: int) -> "Parts":
        """What whole texts have; of equal parts one is encoded."""
        blocks = [(" " + text).encode() if text else b"" for text in texts]
        ends = np.cumsum([len(b) for b in blocks])
        data = np.frombuffer(b"".join(blocks), np.uint8)
        starts = part_starts(data, ends, self._uncut)
        which, first = equal_parts(data, starts)
        stop = np.append(starts[1:], len(data))
        parts = [data[a:b].tobytes().decode() for a, b in zip(starts[first].tolist(), stop[first].tolist(), strict=True)]
        alone, together = [], []
        for k, part in enumerate(parts):
            (alone if part[-1].isspace() else together).append(k)
        found = Parts.joined(([self.learn([parts[k] for k in together], steps)] if together else []) + [self.learn([parts[k]], steps) for k in alone])
        place = np.zeros(len(parts), np.int64)
        place[together + alone] = np.arange(len(parts))
        return found.gathered(place[which], np.searchsorted(starts, np.append(0, ends)))

    def written(self, a_ids: np.ndarray, b_ids: np.ndarray, a_cuts: np.ndarray, b_cuts: np.ndarray) -> list[str]:
        """The ids of closed groups in the order in which they are written, each with what follows it."""
        place = np.zeros(len(a_ids) + len(b_ids), np.int64)
        for ids, cuts, others, base in (
            (a_ids, a_cuts, np.append(0, b_cuts), 0),
            (b_ids, b_cuts, a_cuts, 2 * len(self.a)),
        ):
            last = np.zeros(len(ids), np.int64)
            last[cuts - 1] = 1
            group = np.cumsum(last) - last
            place[np.arange(len(ids)) + others[group]] = base + 2 * ids + last
        return self._written[place].tolist()

    def links(self, piece: Piece, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.pairs.numbers(np.append(piece.a_ids, piece.a_before_id)[a], piece.b_ids[b]).astype(np.int32)


@lru_cache(maxsize=1)
def aligner_of(file: bytes, model: bytes, keys: bytes) -> Aligner:
    """One for all tasks of a worker: making it anew costs time and leaves memory behind."""
    return Aligner(file, model, np.frombuffer(keys, np.int64))


def part_starts(data: np.ndarray, ends: np.ndarray, uncut: bool) -> np.ndarray:
    """Where parts begin in the UTF-8 of texts: at texts, and at blanks behind a character that is no white space."""
    begin = np.zeros(len(data) + 1, bool)
    begin[np.append(0, ends)] = True
    if not uncut and len(data) > 3:
        one, two, three = (np.concatenate([np.zeros(k, np.uint8), data[:-k]]) for k in (1, 2, 3))
        space = ((one >= 9) & (one <= 13)) | ((one >= 28) & (one <= 32)) | ((two == 0xC2) & ((one == 0x85) | (one == 0xA0)))
        space |= ((three == 0xE1) & (two == 0x9A)) | ((three == 0xE2) & ((two == 0x80) | (two == 0x81))) | ((three == 0xE3) & (two == 0x80))
        begin[:-1] |= (data == 32) & ~space
    return np.flatnonzero(begin[:-1])


@dataclass
class Parts:
    """Tokens of both sides, groups, written groups, pair numbers one behind the other, and whether tokens give the part again."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    groups: list[str]
    links: np.ndarray
    good: np.ndarray

    @staticmethod
    def joined(some: list["Parts"]) -> "Parts":
        if not some:
            return Parts(*np.zeros((3, 0), np.int64), [], np.zeros(0, np.int32), np.zeros(0, bool))
        arrays = {name: np.concatenate([getattr(p, name) for p in some]) for name in ("n_a", "n_b", "n_groups", "links", "good")}
        return Parts(**arrays, groups=list(chain.from_iterable(p.groups for p in some)))

    def gathered(self, which: np.ndarray, bounds: np.ndarray) -> "Parts":
        """Of texts made of the parts ``which``, cut at ``bounds``; a text with a part that is not good has nothing."""
        upto = np.append(0, np.cumsum(self.good[which]))
        good = upto[bounds[1:]] - upto[bounds[:-1]] == bounds[1:] - bounds[:-1]
        use = np.repeat(good, np.diff(bounds))
        sums = []
        for n in (self.n_a, self.n_b, self.n_groups):
            upto = np.append(0, np.cumsum(np.where(use, n[which], 0)))
            sums.append(upto[bounds[1:]] - upto[bounds[:-1]])
        written = np.array(self.groups, object)[which]
        groups = [";".join(written[a:b]) if ok else "" for a, b, ok in zip(bounds.tolist(), bounds[1:].tolist(), good.tolist(), strict=False)]
        sizes = np.where(use, self.n_groups[which], 0)
        begins = (np.cumsum(self.n_groups) - self.n_groups)[which]
        at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(begins, sizes)
        return Parts(*sums, groups, self.links[at], good)


def _lists(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(flat.astype(np.int32)))


def _align(batches: Iterator[pa.RecordBatch], aligner: Aligner, keep: list[str], steps: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "_text", 1 << 19):
            has = aligner.texts(part.column("_text").to_pylist(), steps)
            new = [pa.array(has.n_a), pa.array(has.n_b), pa.array(has.n_groups), pa.array(has.groups, pa.string()), _lists(has.links, has.n_groups)]
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keep))), *new], [*keep, *NEW])


LISTS = ("a_ids", "a_ends", "b_ids", "b_ends")
PLACE = ("_piece", "a_from", "b_from", "a_before", "a_before_id")
PIECE_FIELDS = ", ".join([*(f"{name} long" for name in PLACE), *(f"{name} array<long>" for name in LISTS)])
PART_FIELDS = "_piece long, n_a long, n_b long, n_groups long, head_a array<long>, head_b array<long>, body string, tail_a array<long>, tail_b array<long>, links array<int>"


def _cut(batches: Iterator[pa.RecordBatch], aligner: Aligner, keep: list[str], steps: int) -> Iterator[pa.RecordBatch]:
    """The pieces of long texts; a text without tokens has one empty piece."""
    for batch in batches:
        for row in range(batch.num_rows):
            one = batch.slice(row, 1)
            a_ids, b_ids = aligner.tokens(one.column("_text").to_pylist())[0]
            pieces = cut(a_ids, np.cumsum(aligner.a_sizes[a_ids]), b_ids, np.cumsum(aligner.b_sizes[b_ids]), steps) or [Piece(a_ids, a_ids, b_ids, b_ids)]
            for k, p in enumerate(pieces):
                place = [pa.array([x], pa.int64()) for x in (k, p.a_from, p.b_from, p.a_before, p.a_before_id)]
                lists = [pa.array([getattr(p, name)], pa.list_(pa.int64())) for name in LISTS]
                yield pa.RecordBatch.from_arrays([*(one.column(c) for c in range(len(keep))), *place, *lists], [*keep, *PLACE, *LISTS])


def _align_pieces(batches: Iterator[pa.RecordBatch], aligner: Aligner, keep: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            one = batch.slice(row, 1)
            values = {name: one.column(name)[0] for name in (*PLACE, *LISTS)}
            lists = [values[name].values.to_numpy(zero_copy_only=False) for name in LISTS]
            piece = Piece(*lists, *(values[name].as_py() for name in PLACE[1:]))
            a, b, closed = piece.overlaps()
            a, b = a[closed] + 1, b[closed] + 1
            first, last = ((a[0], b[0]), (a[-1], b[-1])) if len(a) else ((len(piece.a_ids), len(piece.b_ids)),) * 2
            body = aligner.written(piece.a_ids[first[0] : last[0]], piece.b_ids[first[1] : last[1]], a[1:] - first[0], b[1:] - first[1])
            part = {
                "_piece": values["_piece"].as_py(),
                "n_a": len(piece.a_ids),
                "n_b": len(piece.b_ids),
                "n_groups": len(a),
                "head_a": piece.a_ids[: first[0]],
                "head_b": piece.b_ids[: first[1]],
                "body": "".join(body),
                "tail_a": piece.a_ids[last[0] :],
                "tail_b": piece.b_ids[last[1] :],
                "links": aligner.links(piece, a - 1, b - 1),
            }
            new = [pa.array([part[field.name]], field.type) for field in schema]
            yield pa.RecordBatch.from_arrays([*(one.column(c) for c in range(len(keep))), *new], [*keep, *schema.names])


def stitched(parts: list[dict]) -> str:
    """The written groups of a text from those of its pieces in order."""
    out, open_a, open_b = [], [], []
    for part in parts:
        open_a, open_b = open_a + part["head_a"], open_b + part["head_b"]
        if part["n_groups"]:
            out += [",".join(map(str, open_a)), "|", ",".join(map(str, open_b)), ";", part["body"]]
            open_a, open_b = part["tail_a"], part["tail_b"]
    return "".join(out)[:-1]


def _stitch(batches: Iterator[pa.RecordBatch], keep: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            parts = batch.column("parts")[row].as_py()
            new = [
                *(pa.array([sum(p[name] for p in parts)], pa.int64()) for name in NEW[:3]),
                pa.array([stitched(parts)], pa.string()),
                pa.array([[k for p in parts for k in p["links"]]], pa.list_(pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(row, 1) for k in keep), *new], [*keep, *NEW])


def _kept(df: DataFrame, keep: tuple[str, ...]) -> str:
    return "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keep)


def aligned(
    spark: SparkSession, docs: DataFrame, *keep: str, byte_level: str = BYTE_LEVEL, model: str = MODEL, long_bytes: int = LONG_BYTES, steps: int = PIECE_STEPS
) -> DataFrame:
    """``keep..., n_a, n_b, n_groups, groups, links`` of every whole ``text``.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``: decimal ids of each group in order.  ``links`` holds the number of the pair
    (last A id, last B id) of each group, see ``Pairs``.
    """
    taken = {*NEW, *PLACE, *LISTS, "parts", "_text", "_row"} & set(keep)
    if taken:
        raise ValueError(f"kept columns may not be named {', '.join(sorted(taken))}")
    vocabularies = vocabulary(byte_level), vocabulary(model)
    keys = Pairs(side_a(vocabularies[0]), side_b(vocabularies[1])).keys.tobytes()
    names = list(keep)
    texts = docs.select(*keep, F.col("text").alias("_text"))
    is_long = F.coalesce(F.octet_length("_text"), F.lit(0)) > long_bytes
    short = texts.filter(~is_long).mapInArrow(lambda batches: _align(batches, aligner_of(*vocabularies, keys), names, steps), _kept(docs, keep) + FIELDS)

    # staged, so that a row keeps its number
    carried, kept = ["_row", *names], "_row long, " + _kept(docs, keep)
    numbered = texts.filter(is_long).select(F.monotonically_increasing_id().alias("_row"), *keep, "_text")
    pieces = staged(spark, numbered.mapInArrow(lambda batches: _cut(batches, aligner_of(*vocabularies, keys), carried, steps), kept + PIECE_FIELDS), "pieces")
    run = pa.list_(pa.int64())
    kinds = {"head_a": run, "head_b": run, "tail_a": run, "tail_b": run, "body": pa.string(), "links": pa.list_(pa.int32())}
    schema = pa.schema([(name, kinds.get(name, pa.int64())) for name in (field.split(" ")[0] for field in PART_FIELDS.split(", "))])
    parts = pieces.repartition("_row", "_piece").mapInArrow(
        lambda batches: _align_pieces(batches, aligner_of(*vocabularies, keys), carried, schema), kept + PART_FIELDS
    )
    whole = parts.groupBy("_row").agg(
        *(F.first(k).alias(k) for k in keep), F.sort_array(F.collect_list(F.struct(*schema.names))).alias("parts")
    )
    return short.unionByName(whole.mapInArrow(lambda batches: _stitch(batches, names), _kept(docs, keep) + FIELDS))


def pair_counts(rows: DataFrame) -> DataFrame:
    """``pair, n``: how many links of all ``rows`` hold each pair; at most as many rows as ``Pairs`` has keys."""
    return rows.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


def _counted(batches: Iterator[pa.RecordBatch], best: np.ndarray, count: np.ndarray, others: list[str]) -> Iterator[pa.RecordBatch]:
    """``others, n_best, count_sum`` of each row; about ``RUN_LINKS`` links are looked up at a time, a batch holds millions."""
    for batch in batches:
        lengths = batch.column("links").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        run = np.cumsum(lengths, dtype=np.int64) // RUN_LINKS
        edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(edges, edges[1:], strict=False):
            part = batch.slice(lo, hi - lo)
            ends = np.append(0, np.cumsum(lengths[lo:hi]))
            flat = part.column("links").flatten().to_numpy()
            sums = [np.append(0, np.cumsum(values[flat], dtype=np.int64)) for values in (best, count)]
            new = [pa.array(s[ends[1:]] - s[ends[:-1]]) for s in sums]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), *new], [*others, "n_best", "count_sum"])


def with_counts(rows: DataFrame, counts: DataFrame, byte_level: str = BYTE_LEVEL, model: str = MODEL) -> DataFrame:
    """``rows`` with ``n_best, count_sum`` instead of ``links``.

    ``counts`` is gathered: the vocabularies bound it, the corpus does not enter.
    """
    b = side_b(vocabulary(model))
    keys = Pairs(side_a(vocabulary(byte_level)), b).keys
    table = counts.toArrow()
    count = np.zeros(len(keys), np.int64)
    count[table.column("pair").to_numpy()] = table.column("n").to_numpy()
    highest = np.zeros(len(b), np.int64)
    np.maximum.at(highest, keys % len(b), count)
    best = count == highest[keys % len(b)]
    others = [c for c in rows.columns if c != "links"]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in others)
    return rows.mapInArrow(lambda batches: _counted(batches, best, count, others), f"{kinds}, n_best long, count_sum long")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    with small_batches(spark):
        rows = aligned(spark, read(spark, sf_dir, "documents"), "doc_id")
        digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
        narrow = staged(spark, rows.select("doc_id", "n_a", "n_b", "n_groups", F.size("links").cast("long").alias("n_links"), digest, "links"), "links")
        out = with_counts(narrow, pair_counts(narrow))
        return staged(spark, out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"), "counted")
