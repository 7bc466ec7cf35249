"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames with a few whole WARC records each,
and a last, skippable frame that lists the sizes of all others (the seekable format), so
any Zstandard tool reads the whole file and a reader of one record decompresses one frame.
The index, a table, maps each record's identifier to its bundle, its frame and its place
within the frame.

Each task writes bundles of its own, named anew by each attempt; only those of the attempt
whose index rows Spark commits are named by the index, so a lost executor or a speculative
task leaves an unused file and nothing else. A task holds one frame and one batch of rows.

Of the records with equal payloads of `min_bytes` bytes or more, that of the smallest page_id
is a response and the others are revisits, which refer to it and hold no payload. Equal
payloads are those of equal SHA-1 and length.

Defined cases: a null payload is empty. A null page_id counts as larger than any; where all
of a group are null all are responses, as are rows that repeat the smallest page_id of their
group. A null url becomes about:blank; control characters, spaces and bytes beyond ASCII of
urls are percent-encoded. A payload larger than a frame has a frame of its own. An empty
table gives no bundles and an empty index. Columns beyond the three are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsmith.llm.common import materialize, work_dir

#: Bytes of records in a frame, and of compressed frames or records in a bundle, before the next begins.
FRAME, BUNDLE, RECORDS = 1 << 20, 256 << 20, 100_000
LEVEL = 3
#: Fixed values of the Zstandard seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: A fixed value of WARC 1.1.
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, record_id string, record_type string, bundle string, frame_offset long, frame_bytes long, offset long, bytes long"
RECORD = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


# ------------------------------------------------------------------ bundles


class Bundle:
    """Writes one seekable file: add() records, close() the table."""

    def __init__(self, out: pa.NativeFile, level: int = LEVEL, frame: int = FRAME) -> None:
        self.out, self.limit = out, frame
        self.coder = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.held: list[bytes] = []
        self.size, self.written, self.frames = 0, 0, []

    def add(self, record: bytes) -> tuple[int, int]:
        """The record's frame (by number) and its offset there."""
        if self.held and self.size + len(record) > self.limit:
            self.flush()
        at = len(self.frames), self.size
        self.held.append(record)
        self.size += len(record)
        return at

    def flush(self) -> None:
        if self.held:
            data = self.coder.compress(b"".join(self.held))
            self.out.write(data)
            self.frames.append((self.written, len(data), self.size))
            self.written += len(data)
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", packed, plain) for _, packed, plain in self.frames)
        foot = struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table) + len(foot)) + table + foot)
        self.out.close()


def seek_table(file: pa.NativeFile) -> list[tuple[int, int, int]]:
    """(offset, compressed size, size) of each frame, from the end of the file alone."""
    size = file.size()
    file.seek(max(size - 9, 0))
    foot = file.read(9)
    if len(foot) < 9 or struct.unpack("<I", foot[5:])[0] != SEEKABLE:
        raise ValueError("no seek table at the end of the bundle")
    count, flags = struct.unpack("<IB", foot[:5])
    step = 12 if flags & 0x80 else 8  # a checksum may follow each entry's sizes
    file.seek(size - 9 - count * step - 8)
    head = file.read(8)
    if struct.unpack("<II", head) != (SKIPPABLE, count * step + 9):
        raise ValueError("the seek table's frame is broken")
    sizes = np.frombuffer(file.read(count * step), "<u4").reshape(count, step // 4)[:, :2].astype(np.int64)
    ends = np.cumsum(sizes[:, 0])
    return list(zip((ends - sizes[:, 0]).tolist(), sizes[:, 0].tolist(), sizes[:, 1].tolist(), strict=True))


def frame(file: pa.NativeFile, offset: int, packed: int) -> bytes:
    file.seek(offset)
    return zstandard.ZstdDecompressor().decompress(file.read(packed))


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """A path or address of any store that Arrow knows."""
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9+.-]+:/", path) else (fs.LocalFileSystem(), path)


# ------------------------------------------------------------------ records


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}:{digest}>"


def _page_of(identifier: str) -> int | None:
    return int(n) if (n := identifier.split(":")[2]) else None


def safe_url(url: str | None) -> str:
    """What may stand in a header line."""
    if not url:
        return "about:blank"
    return "".join(chr(b) if 0x20 < b < 0x7F else f"%{b:02X}" for b in url.encode())


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _info(date: str) -> bytes:
    return _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, revisit: bool, first: int | None, date: str) -> bytes:
    """A response with its payload, or a revisit with the response's HTTP header alone."""
    kind = "revisit" if revisit else "response"
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date), ("WARC-Target-URI", safe_url(url)), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if revisit:
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(first, digest))]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return _record([*fields, ("Content-Type", "application/http;msgtype=response")], http if revisit else http + payload)


def _head(data: bytes, at: int) -> tuple[dict[str, str], int]:
    """Fields of a header, and where its block begins. Names are in lower case."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, end + 4


def records(data: bytes, at: int = 0) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and blocks of the records that stand end to end from `at`."""
    while at < len(data):
        if data[at : at + 5] != b"WARC/":
            raise ValueError(f"no record at {at}")
        fields, start = _head(data, at)
        end = start + int(fields["content-length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} is cut")
        yield fields, data[start:end]
        at = end + 4


def parsed(fields: dict[str, str], block: bytes) -> tuple | None:
    """A row of RECORD; none for records that aren't pages. A payload that doesn't
    answer its digest is an error."""
    kind = fields["warc-type"]
    if kind not in ("response", "revisit"):
        return None
    http, start = _head(block, 0)
    size, payload = int(http["content-length"]), block[start:] if kind == "response" else None
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if payload is not None and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"the payload of {fields['warc-record-id']} is damaged")
    refers = _page_of(fields["warc-refers-to"]) if kind == "revisit" else None
    return _page_of(fields["warc-record-id"]), fields["warc-target-uri"], kind, payload, size, digest, refers


# ------------------------------------------------------------------ tables


def roles(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, payload, sha1, revisit, first: what each record will be. Only payloads that
    stand more than once are joined with, as a table, so rows of a very frequent one can be dealt to many tasks."""
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    own = own.withColumns({"sha1": F.sha1("payload"), "size": F.length("payload")})
    again = own.filter(F.col("size") >= min_bytes).groupBy("sha1", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("many")).filter("many > 1").drop("many")
    joined = own.join(materialize(again, "payloads"), ["sha1", "size"], "left")
    return joined.select("page_id", "url", "payload", "sha1", (F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))).alias("revisit"), "first")


def write(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, level: int = LEVEL, frame_bytes: int = FRAME, bundle_bytes: int = BUNDLE, date: str | None = None, **columns: str) -> DataFrame:
    """Write a record for each row of pages into bundles under folder, which all executors and the driver
    must share, and return the index (schema INDEX), written as a table. columns: id_col, url_col, html_col."""
    folder = f"{(folder or work_dir(pages.sparkSession)).rstrip('/')}/warc-{uuid.uuid4().hex}"
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def put(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(folder)
        bundle, name, rows = None, "", []

        def index() -> pa.RecordBatch:
            at = bundle.frames
            cols = [*zip(*rows, strict=True)]
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1]), pa.array(cols[2]), pa.array([name] * len(rows)), pa.array([at[i][0] for i in cols[3]], pa.int64()), pa.array([at[i][1] for i in cols[3]], pa.int64()), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.int64())],
                names=["page_id", "record_id", "record_type", "bundle", "frame_offset", "frame_bytes", "offset", "bytes"],
            )

        for batch in batches:
            names = batch.schema.names
            page, url, payload, sha1, revisit, first = (batch.column(names.index(c)) for c in ("page_id", "url", "payload", "sha1", "revisit", "first"))
            for i in range(batch.num_rows):
                if bundle is None:
                    store.create_dir(base, recursive=True)
                    file = f"{uuid.uuid4().hex}.warc.zst"
                    name, bundle, rows = f"{folder}/{file}", Bundle(store.open_output_stream(f"{base}/{file}", compression=None), level, frame_bytes), []
                    bundle.add(_info(date))
                    bundle.flush()
                p, digest = page[i].as_py(), base64.b32encode(bytes.fromhex(sha1[i].as_py())).decode()
                again = revisit[i].as_py()
                data = page_record(p, url[i].as_py(), payload[i].as_py(), digest, again, first[i].as_py(), date)
                rows.append((p, record_id(p, digest), "revisit" if again else "response", *bundle.add(data), len(data)))
                if bundle.written >= bundle_bytes or len(rows) >= RECORDS:
                    bundle.close()
                    yield index()
                    bundle = None
        if bundle:
            bundle.close()
            yield index()

    return materialize(roles(pages, min_bytes, **columns).mapInArrow(put, INDEX), "warc-index")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=[c.split()[0] for c in RECORD.split(", ")])


def read(bundles: DataFrame, payloads: bool = True, split: int = 32 << 20) -> DataFrame:
    """All page records (schema RECORD) of the bundles named by the column `bundle`, once each. The
    seek tables cut bundles into runs of frames of about `split` bytes, which are dealt to tasks."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, base = opened(path)
                with store.open_input_file(base) as file:
                    at = np.array(seek_table(file), np.int64).reshape(-1, 3)
                part = np.concatenate([[0], np.cumsum(at[:, 1])[:-1]]) // split if len(at) else []
                first = np.flatnonzero(np.diff(part, prepend=-1))
                sizes = [s.tolist() for s in np.split(at[:, 1], first[1:])]
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(first)), pa.array(at[first, 0]), pa.array(sizes, pa.list_(pa.int64()))], names=["bundle", "start", "frames"])

    def take(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at, sizes in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                store, base = opened(path)
                with store.open_input_file(base) as file:
                    for packed in sizes:
                        if rows := [r for fields, block in records(frame(file, at, packed)) if (r := parsed(fields, block))]:
                            yield _rows(rows if payloads else [(*r[:3], None, *r[4:]) for r in rows])
                        at += packed

    runs = bundles.select("bundle").distinct().mapInArrow(cut, "bundle string, start long, frames array<long>")
    return runs.repartition(F.xxhash64("bundle", "start")).mapInArrow(take, RECORD)


def lookup(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records (schema RECORD) whose index rows have a record_id of the table wanted: each
    frame that holds one is read and decompressed once."""

    def take(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, data = None, b""
        for batch in batches:
            rows = []
            for path, at, packed, offset, size in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if (path, at) != last:
                    store, base = opened(path)
                    with store.open_input_file(base) as file:
                        last, data = (path, at), frame(file, at, packed)
                rows += [r for fields, block in records(data[offset : offset + size]) if (r := parsed(fields, block))]
            if rows:
                yield _rows(rows)

    found = index.join(wanted.select("record_id").distinct(), "record_id", "left_semi").select("bundle", "frame_offset", "frame_bytes", "offset", "bytes")
    return found.repartition("bundle", "frame_offset").sortWithinPartitions("bundle", "frame_offset", "offset").mapInArrow(take, RECORD)


def archive(spark: SparkSession, pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write all pages and read the archives back, without payloads."""
    return read(write(pages, folder, min_bytes), payloads=False)
