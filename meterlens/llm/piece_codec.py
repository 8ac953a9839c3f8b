"""Encoding and decoding with a merge-type SentencePiece model, exactly as its library does.

The library merges neighbours by priority, which is slow on long runs of letters.  Here a text is read from left to
right: an Aho-Corasick automaton over all pieces gives the longest piece that starts at each character, and a piece
is taken if it may stand behind the one before it.  Two pieces may be neighbours if merging their joined text anew
gives just these two; a sequence is the result of merging if and only if all its neighbours may be.  Where no piece
fits, the last one is given up for its next shorter prefix.  The pieces that lead to a position are always the same,
so a position that failed once is marked in a bitfield and never tried again; the work is linear in the text.

Equal priorities (runs of blanks have them) go to the leftmost pair, as in the library.  Texts are cut where no merge
can reach across: before a run of blanks, and beside characters that no piece contains; parts are remembered per
worker, ``REMEMBERED`` at most, which changes the speed only.

One narrow pass, no shuffle: a task that is run again gives the same rows.  The model (half a megabyte) is read by
the driver and sent to the tasks.

Defined cases: a null or empty text has no ids and is decoded to an empty text; repeated rows, null ids of documents
and ties are encoded like any others; strings that look like control pieces are ordinary text; characters outside
the vocabulary become their UTF-8 bytes; ``decoded`` writes U+FFFD for each byte that is no valid UTF-8, ``" ⁇ "``
for an unknown id and nothing for control ids, null ids count as none; an empty table gives no rows.  Other columns
are carried only if named in ``keep``, which must not name the new column (ValueError).  Models of another type, with
a normaliser, with unused or user-defined pieces or without byte fallback are refused (ValueError).
"""

from __future__ import annotations

import re
import struct
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlens.llm.common import read
from meterlens.llm.packing import vocabulary
from meterlens.llm.textnum import slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
REMEMBERED = 1 << 19
#: Parts of more characters are not remembered.
REMEMBERED_CHARS = 48
#: Texts decoded at a time.
ROWS = 256

# fixed values of the model format
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE = 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a serialised message: varints as numbers, all else as bytes."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < end:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, data[at : at + size]
        at += size


class PieceCodec:
    """Encoder and decoder of one model."""

    def __init__(self, model: bytes):
        top: dict[int, list] = {}
        for field, value in _fields(model):
            top.setdefault(field, []).append(value)
        trainer, normaliser = (dict(_fields(top[k][0])) for k in (2, 3))
        if trainer.get(3, 1) != BPE or trainer.get(24) or not trainer.get(35):
            raise ValueError("only models of merge type with byte fallback and leading blanks are supported")
        if normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(3, 1) or not normaliser.get(5, 1):
            raise ValueError("only models that leave texts as they are, but for a leading blank, are supported")
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.bytes_of: list[bytes] = []  # what an id adds to a decoded text
        self.byte_ids = [0] * 256
        self.raw: set[int] = set()
        self.silent: set[int] = set()
        for k, message in enumerate(top[1]):
            entry = dict(_fields(message))
            piece, kind = entry[1].decode(), entry.get(3, NORMAL)
            if kind == NORMAL:
                self.ids[piece] = k
                self.scores[piece] = struct.unpack("<f", entry[2])[0] if 2 in entry else 0.0
                self.bytes_of.append(piece.replace(BLANK, " ").encode())
            elif kind == BYTE:
                value = int(piece[3:5], 16)
                self.byte_ids[value] = k
                self.raw.add(k)
                self.bytes_of.append(bytes([value]))
            elif kind in (UNKNOWN, CONTROL):
                self.silent.add(k)
                self.bytes_of.append(" ⁇ ".encode() if kind == UNKNOWN else b"")
            else:
                raise ValueError(f"piece {piece!r} is of a kind that is not supported")
        self._automaton = None
        self._known: dict[str, tuple[int, ...]] = {}
        self._fit: defaultdict[str, dict[str, bool]] = defaultdict(dict)
        self._pairs = 0

    def _prepare(self) -> None:
        """What only encoding needs."""
        self._automaton = ahocorasick.Automaton()
        for piece in self.ids:
            self._automaton.add_word(piece, len(piece))
        self._automaton.make_automaton()
        inner = "".join(map(re.escape, sorted({c for p in self.ids for c in p} - {BLANK})))
        crossing = any(re.search(f"[^{BLANK}]{BLANK}", p) for p in self.ids)
        self._parts = re.compile(f"[{BLANK}{inner}]+|." if crossing else f"{BLANK}*[{inner}]+|{BLANK}+|.", re.DOTALL).findall
        # length of the longest piece that is a proper prefix; a single character always is one, 0 if none is left
        self._shorter = {p: next((n for n in range(len(p) - 1, 1, -1) if p[:n] in self.ids), min(len(p) - 1, 1)) for p in self.ids}

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging alone: highest score first, leftmost among equals."""
        symbols = list(text)
        score = self.scores.get
        pairs = [score(a + b) for a, b in zip(symbols, symbols[1:], strict=False)]
        while True:
            best, at = None, -1
            for k, s in enumerate(pairs):
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = score(symbols[at] + symbols[at + 1])
            if at > 0:
                pairs[at - 1] = score(symbols[at - 1] + symbols[at])

    def fits(self, left: str, right: str) -> bool:
        """Whether ``right`` may stand behind ``left``."""
        return self.merged(left + right) == ([left, right] if left else [right])

    def _behind(self, left: str, right: str) -> bool:
        found = self._fit[left].get(right)
        if found is None:
            if self._pairs >= REMEMBERED:
                for some in self._fit.values():  # emptied in place: a caller may hold one
                    some.clear()
                self._pairs = 0
            self._pairs += 1
            found = self._fit[left][right] = self.fits(left, right)
        return found

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text whose blanks are replaced; a character outside the vocabulary is one of them."""
        if self._automaton is None:
            self._prepare()
        n, matches, fit, shorter = len(text), self._automaton.iter_long, self._fit, self._shorter
        taken: list[str] = []
        failed: bytearray | None = None  # one bit for each position
        before, at = "", 0
        while at < n:
            piece = ""
            for last, size in matches(text, at):  # longest matches one behind the other, as long as they fit
                end = last + 1
                if end - size != at:
                    break
                piece = text[at:end]
                if failed is not None and failed[end >> 3] >> (end & 7) & 1:
                    break
                if not (fit[before].get(piece) or self._behind(before, piece)):
                    break
                taken.append(piece)
                before, at, piece = piece, end, ""
            if at == n:
                break
            # a character of no piece, or a shorter prefix, or another piece before
            size = shorter.get(piece, 0) if piece else 1
            while True:
                while size == 0:
                    if failed is None:
                        failed = bytearray((n >> 3) + 1)
                    failed[at >> 3] |= 1 << (at & 7)
                    piece = taken.pop()
                    at -= len(piece)
                    before = taken[-1] if taken else ""
                    size = shorter.get(piece, 0)
                end = at + size
                piece = text[at:end]
                if (failed is None or not failed[end >> 3] >> (end & 7) & 1) and (fit[before].get(piece) or self._behind(before, piece)):
                    break
                size = shorter.get(piece, 0)
            taken.append(piece)
            before, at = piece, end
        return taken

    def _part(self, part: str) -> tuple[int, ...]:
        pieces = self.pieces(part)
        ids = tuple(map(self.ids.get, pieces))
        if None in ids:
            ids = tuple(j for k, piece in zip(ids, pieces, strict=True) for j in ([k] if k is not None else map(self.byte_ids.__getitem__, piece.encode())))
        if len(part) <= REMEMBERED_CHARS:
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            self._known[part] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if self._automaton is None:
            self._prepare()
        parts = self._parts(BLANK + text.replace(" ", BLANK))
        found = list(map(self._known.get, parts))
        if None in found:
            known = self._known
            found = [(known.get(part) or self._part(part)) if ids is None else ids for part, ids in zip(parts, found, strict=True)]
        return list(chain.from_iterable(found))

    def decode(self, ids: list[int]) -> str:
        table = self.bytes_of
        parts = [table[k] for k in ids]
        for n, k in enumerate(ids):  # the leading blank that encoding adds
            if k not in self.silent or parts[n]:
                if k not in self.raw and parts[n].startswith(b" ") and k not in self.silent:
                    parts[n] = parts[n][1:]
                break
        whole = b"".join(parts)
        try:
            return whole.decode()
        except UnicodeDecodeError:
            return _each_wrong_byte(whole)


def _each_wrong_byte(data: bytes) -> str:
    """UTF-8 decoded with one U+FFFD for every byte that belongs to no character."""
    out, at = [], 0
    while at < len(data):
        try:
            out.append(data[at:].decode())
            break
        except UnicodeDecodeError as wrong:
            out.append(data[at : at + wrong.start].decode())
            out.append("�")
            at += wrong.start + 1
    return "".join(out)


@lru_cache(maxsize=1)
def codec_of(model: bytes) -> PieceCodec:
    """One for all tasks of a worker, so that its parts are remembered."""
    return PieceCodec(model)


def _kept(df: DataFrame, keep: tuple[str, ...], new: str) -> str:
    if new in keep:
        raise ValueError(f"a kept column may not be named {new}")
    return "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keep)


def encoded(docs: DataFrame, *keep: str, path: str = MODEL) -> DataFrame:
    """``keep..., ids array<int>``: the ids of every whole ``text``."""
    model = vocabulary(path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model)
        for batch in batches:
            for part in slices(batch, "_text", 1 << 20):
                ids = [codec.encode(text or "") for text in part.column("_text").to_pylist()]
                flat = np.array(list(chain.from_iterable(ids)), np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)], dtype=np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keep))), lists], [*keep, "ids"])

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(work, f"{_kept(docs, keep, 'ids')}ids array<int>")


def decoded(rows: DataFrame, *keep: str, path: str = MODEL) -> DataFrame:
    """``keep..., decoded string``: the text of every ``ids``."""
    model = vocabulary(path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                lists = part.column("_ids")
                ends = np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))).tolist()
                flat = lists.flatten().to_numpy()
                texts = [codec.decode(flat[a:b].tolist()) for a, b in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keep))), pa.array(texts, pa.string())], [*keep, "decoded"])

    return rows.select(*keep, F.col("ids").alias("_ids")).mapInArrow(work, f"{_kept(rows, keep, 'decoded')}decoded string")


def op13_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = encoded(read(spark, sf_dir, "documents"), "doc_id")
    digests = ids.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), "ids"
    )
    texts = decoded(digests, "doc_id", "n_tokens", "ids_sha256")
    return texts.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
