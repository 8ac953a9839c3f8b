"""WARC archives with dictionary-compressed records (.warc.zst), written and read back as tables of archives.

Each task writes its pages into archives of at most ``ARCHIVE_BYTES`` of records (a larger record has one of
its own).  An archive begins with a skippable frame (magic 0x184D2A5D) that holds a Zstandard dictionary
built from the archive's own records, slices of at most ``SAMPLE_BYTES`` in all, spread over records and their lengths; every record follows as a frame of
its own, compressed with that dictionary, so each can be read alone by its offset.  Archives are rows
(archive id, bytes), since only Spark reaches every store; ``tofile`` of the bytes is the .warc.zst file.

Of records with equal payloads the one with the largest page_id is a response with the payload, the others
are revisits that refer to it.  Equality is that of SHA-1 digests, counted over all pages.

Defined cases: a null html is an empty payload; rows repeated with the page_id of the response are responses
too; a null page_id is smaller than any other and, if alone, is its own response; a null url is written as
an empty one; other columns are ignored; an empty table gives no archives.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlens.llm.common import read, staged
from meterlens.llm.textnum import slices

MAGIC = 0x184D2A5D
ARCHIVE_BYTES = 8 << 20
SAMPLE_BYTES = 1 << 20
DICTIONARY_BYTES = 32 << 10
LEVEL = 3
MIN_REVISIT_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
RESULT = "page_id {kind}, payload_bytes long, payload_digest string, record_type string, refers_to {kind}"


def _record(page_id, url: str | None, digest: str, size: int, payload: bytes | None, refers_to) -> bytes:
    """A response record, or a revisit where ``payload`` is None."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http + (payload or b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if payload is not None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if payload is None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _dictionary(records: list[bytes], sample_bytes: int) -> bytes:
    """A dictionary from slices of records, at places told by their hashes; a plain-content one where there is too little to train on."""
    share = max(256, sample_bytes // max(1, len(records)))
    marks = [xxhash.xxh64_intdigest(r) for r in records]
    chosen = sorted(range(len(records)), key=marks.__getitem__)[: max(1, sample_bytes // share)]
    samples = []
    for k in sorted(chosen):
        at = marks[k] % (max(0, len(records[k]) - share) + 1)
        samples.append(records[k][at : at + share])
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES].ljust(8, b" ")


def write_archive(records: list[bytes], sample_bytes: int = SAMPLE_BYTES) -> bytes:
    held = _dictionary(records, sample_bytes)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(held), write_checksum=True)
    return b"".join([struct.pack("<II", MAGIC, len(held)), held, *(packer.compress(r) for r in records)])


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one by one."""
    magic, size = struct.unpack_from("<II", data)
    if magic != MAGIC:
        raise ValueError("no dictionary frame")
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    rest = memoryview(data)[8 + size :]
    while len(rest):
        frame = unpacker.decompressobj()
        yield frame.decompress(rest)
        rest = rest[len(rest) - len(frame.unused_data) :]


def _header(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _write(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    records: list[bytes] = []
    total = 0

    def archive() -> pa.RecordBatch:
        data = write_archive(records)
        columns = [pa.array([hashlib.sha1(data).hexdigest()[:16]]), pa.array([len(records)]), pa.array([data], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["archive", "n_records", "data"])

    for batch in batches:
        for part in slices(batch, "html"):
            for row in part.to_pylist():
                payload = (row["html"] or "").encode()
                digest = base64.b32encode(bytes.fromhex(row["sha"])).decode()
                whole = row["response"]
                record = _record(row["page_id"], row["url"], digest, len(payload), payload if whole else None, row["refers_to"])
                if records and total + len(record) > most:
                    yield archive()
                    records, total = [], 0
                records.append(record)
                total += len(record)
    if records:
        yield archive()


def planned(spark: SparkSession, pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``page_id, url, html, sha, response, refers_to`` of every page."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", "html", F.sha1(html.cast("binary")).alias("sha"), F.octet_length(html).alias("n_bytes"))
    largest = rows.filter(F.col("n_bytes") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
    # payloads that are alone need no lookup
    largest = staged(spark, largest.filter("n > 1").select(F.col("sha").alias("d"), "refers_to"), "payloads")
    rows = rows.join(largest, F.col("sha") == F.col("d"), "left")
    revisit = F.col("refers_to").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("refers_to")))
    return rows.select("page_id", "url", "html", "sha", (~revisit).alias("response"), F.when(revisit, F.col("refers_to")).alias("refers_to"))


def archives(spark: SparkSession, pages: DataFrame, most: int = ARCHIVE_BYTES, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``archive, n_records, data``: one row per archive."""
    return planned(spark, pages, min_bytes).mapInArrow(lambda batches: _write(batches, most), "archive string, n_records long, data binary")


def _read(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column("data"):
            rows = []
            for record in read_archive(data.as_py()):
                fields, block = _header(record)
                head, _, payload = block.partition(b"\r\n\r\n")
                size = int(head.decode().rsplit("Content-Length: ", 1)[1])
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if fields["WARC-Type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                    raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
                rows.append((_page(fields["WARC-Record-ID"]), size, digest, fields["WARC-Type"], _page(fields.get("WARC-Refers-To"))))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(columns[0], pa.string()).cast(kind), pa.array(columns[1], pa.int64()), pa.array(columns[2]), pa.array(columns[3]),
                    pa.array(columns[4], pa.string()).cast(kind),
                ],
                ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
            )


def _page(uri: str | None) -> str | None:
    name = uri and uri.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "null" else name


def records(rows: DataFrame, kind: str = "bigint") -> DataFrame:
    """Every record of the archives: payload size and digest are checked for responses."""
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    return rows.select("data").mapInArrow(lambda batches: _read(batches, arrow), RESULT.format(kind=kind))


def op4_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return records(staged(spark, archives(spark, pages), "archives"), pages.schema["page_id"].dataType.simpleString())
