"""WARC archives as seekable Zstandard bundles, and reading records back by their offsets.

A bundle is a run of independent Zstandard frames, each with some whole records, and a seek table in a
skippable frame at its end: per frame its compressed and uncompressed size, then the number of frames,
a descriptor byte and the magic number. Beside it an index maps a record to its frame and its offset in it.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from hashlib import sha1

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm.batches import pieces
from panelloom.sources.tables import materialise

# fixed values of the two formats
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "urn:record:"
UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def record(key: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record; a revisit has no payload."""
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{RECORD}{'' if key is None else key}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {UNSAFE.sub(lambda m: f'%{ord(m[0]):02X}', url)}")
    lines += [f"WARC-Payload-Digest: sha1:{digest}"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{RECORD}{refers_to}>"]
        payload = b""
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return b"".join([*(f"{x}\r\n".encode() for x in lines), b"\r\n", http, payload, b"\r\n\r\n"])


def parse(data: bytes) -> dict:
    """A record's fields; the digest of a response is taken from its payload and compared with the header."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    if first != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"not a record: {data[:80]!r}")
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    if fields["WARC-Type"] == "response" and (sha1(payload).hexdigest() != digest or len(payload) != size):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not fit its digest")
    number = lambda x: int(x) if (x := x.strip("<>").removeprefix(RECORD)) else None
    return {
        "record_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "payload_bytes": size,
        "payload_digest": digest, "refers_to": number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None, "payload": payload if fields["WARC-Type"] == "response" else None,
    }


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(bundle: bytes) -> list[tuple[int, int]]:
    """Per frame its start and its compressed size, from the footer alone."""
    n, _, magic = struct.unpack("<IBI", bundle[-9:])
    start = len(bundle) - 9 - 8 * n
    if magic != SEEKABLE or struct.unpack("<II", bundle[start - 8 : start]) != (SKIPPABLE, 8 * n + 9):
        raise ValueError("no seek table at the bundle's end")
    out, at = [], 0
    for i in range(n):
        size, _ = struct.unpack_from("<II", bundle, start + 8 * i)
        out.append((at, size))
        at += size
    return out


def read_record(bundle: bytes, frame: int, offset: int, length: int) -> bytes:
    """One record by its place: only its frame is decompressed."""
    start, size = read_seek_table(bundle)[frame]
    return zstandard.decompress(bundle[start : start + size])[offset : offset + length]


BUNDLE = "bundle binary, index array<struct<record_id: bigint, frame: int, offset: bigint, length: bigint>>"
INDEX = pa.list_(pa.struct([("record_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))


def _bundles(frame_bytes: int, bundle_bytes: int, raw_bytes: int, records: int, date: str, level: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=level, write_content_size=True)
        frames, sizes, index, open_, filled = [], [], [], [], 0

        def close_frame():
            nonlocal open_, filled
            if open_:
                data = pack.compress(b"".join(open_))
                frames.append(data)
                sizes.append((len(data), filled))
                open_, filled = [], 0

        def close_bundle() -> pa.RecordBatch:
            nonlocal frames, sizes, index
            out = pa.RecordBatch.from_arrays([pa.array([b"".join([*frames, seek_table(sizes)])], pa.binary()), pa.array([index], INDEX)], ["bundle", "index"])
            frames, sizes, index = [], [], []
            return out

        for batch in pieces(batches, 100):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                key, url, payload, size, digest, refers_to = row
                data = record(key, url, payload or b"", size, digest, refers_to, date)
                index.append({"record_id": key, "frame": len(frames), "offset": filled, "length": len(data)})
                open_.append(data)
                filled += len(data)
                if filled >= frame_bytes or len(index) >= records:
                    close_frame()
                    if len(index) >= records or sum(c for c, _ in sizes) >= bundle_bytes or sum(r for _, r in sizes) >= raw_bytes:
                        yield close_bundle()
        close_frame()
        if frames:
            yield close_bundle()

    return each


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    least_bytes: int = 1000,
    frame_bytes: int = 256 << 10,
    bundle_bytes: int = 1 << 20,
    raw_bytes: int = 8 << 20,
    records: int = 8192,
    date: str = "1970-01-01T00:00:00Z",
    level: int = 3,
) -> None:
    """Writes one record per row of pages as bundles with their indexes, a table of rows, to `path`.

    Of equal payloads of at least least_bytes that with the largest id is a response and the others, which
    refer to it, are revisits without a payload; rows that repeat that id and payload are responses too.
    Smaller payloads are all responses. A null payload is empty; a null url is left out; rows with a null id
    refer to the largest id if there is one. A frame ends with the first record that fills it, a bundle
    with the first record or frame that fills it: by its compressed bytes, its bytes or its records. So a very long
    payload makes a long frame of its own, and beside that every bundle stays small, however well its records
    compress. An empty table writes an empty archive.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    given = pages.select(F.col(id_col).cast("long").alias("key"), F.col(url_col).alias("url"), payload.alias("payload"))
    given = given.withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.unhex(F.sha1("payload"))})
    # who refers to whom is decided on ids and digests; payloads then meet only what is known of their own row
    slim = given.where(F.col("size") >= least_bytes).select("key", "digest")
    copies = slim.groupBy("digest").agg(F.max("key").alias("best"), F.count("*").alias("n")).where("n > 1 AND best IS NOT NULL").drop("n")
    copies = materialise(copies, "warc-copies")
    later = slim.join(copies, "digest").where("key IS NULL OR key < best").groupBy("key", "digest").agg(F.max("best").alias("refers_to"))
    later = materialise(later.select(F.col("key").alias("own"), F.col("digest").alias("copied"), "refers_to"), "warc-revisits")
    marked = given.join(later, given["key"].eqNullSafe(later["own"]) & (given["digest"] == later["copied"]), "left")
    kept = F.when(F.col("refers_to").isNull(), F.col("payload"))
    rows = marked.select("key", "url", kept.alias("payload"), "size", F.lower(F.hex("digest")).alias("digest"), "refers_to")
    packed = rows.mapInArrow(_bundles(frame_bytes, bundle_bytes, raw_bytes, records, date, level), BUNDLE)
    packed.write.option("compression", "none").option("parquet.block.size", 8 << 20).mode("errorifexists").parquet(path)


NAMES = ["record_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
KINDS = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]


def _read(columns: int):
    """Records frame by frame, with the first `columns` of NAMES; the others are checked and let go."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                bundle, index = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                places = read_seek_table(bundle)
                at = 0
                while at < len(index):
                    frame, rows = index[at]["frame"], []
                    start, size = places[frame]
                    data = unpack.decompress(bundle[start : start + size])
                    while at < len(index) and index[at]["frame"] == frame:
                        found = parse(data[index[at]["offset"] : index[at]["offset"] + index[at]["length"]])
                        rows.append([found[name] for name in NAMES[:columns]])
                        at += 1
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), KINDS)], NAMES[:columns])

    return each


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """(record_id, url, record_type, payload_bytes, payload_digest, refers_to[, payload]) of every record, found by
    the index and the seek table; payload is null for revisits. A record that does not fit its digest fails, with
    and without its payload in the result."""
    schema = "record_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * payloads
    return archives.select("bundle", "index").mapInArrow(_read(len(NAMES) - (not payloads)), schema)


def fetch(archives: DataFrame, record_ids: list[int]) -> DataFrame:
    """(record_id, record): the records with these ids; only bundles that hold one are read, only their frames
    decompressed. Unknown ids have no row, null is no id, and no ids give an empty result."""
    wanted = {k for k in record_ids if k is not None}
    if not wanted:
        return archives.sparkSession.createDataFrame([], "record_id long, record binary")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                bundle, index = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                found = [(e["record_id"], read_record(bundle, e["frame"], e["offset"], e["length"])) for e in index if e["record_id"] in wanted]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([r for _, r in found], pa.binary())], ["record_id", "record"])

    has = F.exists("index", lambda e: e["record_id"].isin(*wanted))
    return archives.where(has).select("bundle", "index").mapInArrow(each, "record_id long, record binary")
