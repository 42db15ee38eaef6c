"""WARC archives as seekable Zstandard bundles.

Every task writes its records, in order of their ids, into bundles of bounded size: records are grouped into frames that
decompress on their own, and a skippable frame at the end holds the seek table of the public seekable format (sizes of every
frame, their number, a magic number). An index maps each record to bundle, frame, the frame's place and the record's place in
the frame, so that one record is read by decompressing one frame.

Records with equal payloads of at least `least_bytes` bytes are stored once: the one with the largest id is a response, the
others are revisits of it. The owner of a payload is found on digests alone, by a maximum with map-side combining.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.llm.tables import written
from foliomill.session import work_folder

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 64 << 20
LEVEL = 6
CAPTURED = "1970-01-01T00:00:00Z"
#: Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
_FOOTER = struct.Struct("<IBI")
_ENTRY = struct.Struct("<II")
_END = b"\r\n"


def _place(uri: str):
    """The file system and path of a URI or plain path, on any storage that executors share."""
    from pyarrow import fs

    if "://" not in uri:
        return fs.LocalFileSystem(), uri.removeprefix("file:")
    if uri.startswith("file://"):
        return fs.LocalFileSystem(), uri.removeprefix("file://")
    return fs.FileSystem.from_uri(uri)


def digest32(payload: bytes) -> str:
    """SHA-1 in bare upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uuid(key: object) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'record:{key}').urn}>"


def _header_value(value: object) -> bytes:
    """One line: line breaks would end the header."""
    return str(value).replace("\r", "%0D").replace("\n", "%0A").encode("utf-8", "replace")


def record(key: object, url: str | None, payload: bytes, digest: str, owner: object | None) -> bytes:
    """A whole WARC record; `owner` is the response that a revisit refers to, whose block is the HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if owner is None else http
    lines = [
        (b"WARC-Type", "response" if owner is None else "revisit"),
        (b"WARC-Record-ID", record_uuid(key)),
        (b"WARC-Date", CAPTURED),
        (b"WARC-Target-URI", url or ""),
        (b"WARC-Payload-Digest", f"sha1:{digest}"),
        (b"Content-Type", "application/http; msgtype=response"),
        (b"X-Page-ID", "" if key is None else key),
        (b"Content-Length", len(block)),
    ]
    if owner is not None:
        lines[2:2] = [
            (b"WARC-Refers-To", record_uuid(owner)),
            (b"WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            (b"X-Refers-To-Page", owner),
        ]
    head = b"WARC/1.1\r\n" + b"".join(k + b": " + _header_value(v) + _END for k, v in lines)
    return head + _END + block + _END + _END


def parse_records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes, bytes]]:
    """Offset, WARC headers, HTTP header and payload of each record of a decompressed frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].split(_END)
        if lines[0] != b"WARC/1.1":
            raise ValueError("no WARC record here")
        headers = dict(line.decode().split(": ", 1) for line in lines[1:])
        block = data[end + 4 : end + 4 + int(headers["Content-Length"])]
        http, _, payload = block.partition(b"\r\n\r\n")
        yield at, headers, http, payload
        at = end + 4 + len(block) + 4


class _Bundle:
    """A bundle under a temporary name, moved in place when it is whole."""

    def __init__(self, uri: str):
        self.uri = uri
        self.storage, self.path = _place(uri)
        self.storage.create_dir(posixpath.dirname(self.path), recursive=True)
        self.partial = f"{posixpath.dirname(self.path)}/.{uuid.uuid4().hex}.part"
        self.out = self.storage.open_output_stream(self.partial)
        self.compress = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        self.at, self.sizes, self.records = 0, [], []

    def add(self, records: list[tuple[object, bytes]]) -> None:
        data = b"".join(r for _, r in records)
        frame = self.compress.compress(data)
        self.out.write(frame)
        offset = 0
        for key, r in records:
            self.records.append((key, self.uri, len(self.sizes), self.at, len(frame), offset, len(r)))
            offset += len(r)
        self.sizes.append((len(frame), len(data)))
        self.at += len(frame)

    def close(self) -> list[tuple]:
        entries = b"".join(_ENTRY.pack(*s) for s in self.sizes)
        footer = _FOOTER.pack(len(self.sizes), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer)
        self.out.close()
        self.storage.move(self.partial, self.path)
        return self.records


_INDEX = "page_id {}, bundle string, frame int, frame_offset long, frame_bytes long, record_offset long, record_bytes long"
_INDEX_TYPES = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
_INDEX_NAMES = ["page_id", "bundle", "frame", "frame_offset", "frame_bytes", "record_offset", "record_bytes"]


def _write(folder: str, key_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, bundle = TaskContext.get().partitionId(), 0, None
        frame, size = [], 0

        def rows(records: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*records, strict=True))
            arrays = [pa.array(columns[0], key_type), *(pa.array(c, k) for c, k in zip(columns[1:], _INDEX_TYPES, strict=True))]
            return pa.RecordBatch.from_arrays(arrays, _INDEX_NAMES)

        for batch in batches:
            keys, urls, payloads, owners = (batch.column(k) for k in range(4))
            for i in range(batch.num_rows):
                key, owner = keys[i].as_py(), owners[i].as_py()
                payload = payloads[i].as_py() or b""
                frame.append((key, record(key, urls[i].as_py(), payload, digest32(payload), owner)))
                size += len(frame[-1][1])
                if size >= FRAME_BYTES:
                    bundle = bundle or _Bundle(f"{folder}/part-{part:06d}-{number:04d}.warc.zst")
                    bundle.add(frame)
                    frame, size = [], 0
                    if bundle.at >= BUNDLE_BYTES:
                        yield rows(bundle.close())
                        bundle, number = None, number + 1
        if frame:
            bundle = bundle or _Bundle(f"{folder}/part-{part:06d}-{number:04d}.warc.zst")
            bundle.add(frame)
        if bundle:
            yield rows(bundle.close())

    return run


def seek_table(storage, path: str) -> list[tuple[int, int, int]]:
    """(offset, compressed bytes, bytes) of each frame, from a bundle's footer."""
    with storage.open_input_file(path) as f:
        total = f.size()
        n, _, magic = _FOOTER.unpack(f.read_at(_FOOTER.size, total - _FOOTER.size))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"no seek table in {path}")
        entries = f.read_at(n * _ENTRY.size, total - _FOOTER.size - n * _ENTRY.size)
    out, at = [], 0
    for packed, plain in _ENTRY.iter_unpack(entries):
        out.append((at, packed, plain))
        at += packed
    return out


def read_record(bundle: str, frame_offset: int, frame_bytes: int, record_offset: int, record_bytes: int) -> bytes:
    """One record by its index row: reads and decompresses one frame."""
    storage, path = _place(bundle)
    with storage.open_input_file(path) as f:
        frame = f.read_at(frame_bytes, frame_offset)
    return zstandard.decompress(frame)[record_offset : record_offset + record_bytes]


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for bundle in batch.column(0).to_pylist():
            table = seek_table(*_place(bundle))
            columns = [pa.array([bundle] * len(table)), *(pa.array([t[k] for t in table], pa.int64()) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, ["bundle", "frame_offset", "frame_bytes"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page", "url", "payload_bytes", "payload_digest", "record_type", "refers", "payload"]
    for batch in batches:
        for bundle, offset, size in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            storage, path = _place(bundle)
            with storage.open_input_file(path) as f:
                data = zstandard.decompress(f.read_at(size, offset))
            rows = []
            for _, headers, http, payload in parse_records(data):
                response = headers["WARC-Type"] == "response"
                stated = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                length = int(http.rpartition(b"Content-Length: ")[2])
                if response and (digest32(payload) != stated or len(payload) != length):
                    raise ValueError(f"damaged record in {bundle}")
                rows.append((
                    headers["X-Page-ID"], headers["WARC-Target-URI"], length, stated, headers["WARC-Type"],
                    headers.get("X-Refers-To-Page"), payload if response else None,
                ))
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names)


def owners(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """`pages` (page_id, url, payload) with `owner`: the page a revisit refers to, null for responses.

    Ties of the largest id, that is repeated rows, are all responses; a null id neither owns nor is owned by itself.
    """
    digests = pages.select("page_id", F.sha1("payload").alias("digest"), F.length("payload").alias("size"))
    last = digests.where((F.col("size") >= least_bytes) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.max("page_id").alias("last"))
    revisits = digests.where(F.col("size") >= least_bytes).join(last, "digest").where("page_id < last").select("page_id", "digest", F.col("last").alias("owner")).distinct()
    keyed = pages.withColumn("digest", F.sha1("payload"))
    return keyed.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "payload", "owner")


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Writes `pages` (page_id, url, html) below `folder`, on storage that executors share; returns the index, written too.

    A null html is an empty payload, a null url an empty target. Rows are sorted within their task, so a task that runs
    again writes the same bundles, each under a temporary name first. An empty table writes nothing.
    """
    payload = F.coalesce(F.encode("html", "utf-8"), F.lit(b"")).alias("payload")
    kind = pages.schema["page_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    records = owners(pages.select("page_id", "url", payload), least_bytes).sortWithinPartitions("page_id", "url", "payload")
    return written(records.mapInArrow(_write(folder, to_arrow_type(kind)), _INDEX.format(kind.simpleString())), "warc-index")


def read_archives(index: DataFrame) -> DataFrame:
    """All records of the bundles of an index, read from the archives frame by frame, with digests of payloads checked.

    Columns page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits).
    """
    bundles = index.select("bundle").distinct()
    frames = bundles.mapInArrow(_frames, "bundle string, frame_offset long, frame_bytes long").repartition("bundle", "frame_offset")
    schema = "page string, url string, payload_bytes long, payload_digest string, record_type string, refers string, payload binary"
    kind = index.schema["page_id"].dataType
    found = frames.mapInArrow(_read, schema)
    key = lambda c: F.when(F.col(c) != "", F.col(c)).cast(kind)
    return found.select(
        key("page").alias("page_id"), "url", "payload_bytes", "payload_digest", "record_type", key("refers").alias("refers_to"), "payload"
    )


def archive_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes the pages to a new folder below the shared one and reads the archives back."""
    folder = work_folder(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, least_bytes))
