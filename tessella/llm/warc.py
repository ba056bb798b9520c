"""WARC archives in seekable Zstandard bundles.

Records are grouped into frames that are compressed apart, frames into bundles of bounded size. A bundle
ends with a seek table in a skippable frame (compressed and plain size of every frame, as the seekable
format lays it down), before which another skippable frame maps record identifiers to a frame and an
offset inside it. So one record is read by decompressing one frame. A bundle is a file of its own, or a
row of a Parquet table: Spark's writer commits those on any store, and a lost executor costs a task.
"""

from __future__ import annotations

import hashlib
import io
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import columns as C
from tessella.llm.scratch import stored

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 16 << 20
#: Fixed values of the Zstandard and seekable formats.
SKIPPABLE, SEEK_MAGIC, TABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1, 0x184D2A5D
#: Payloads of equal bytes are stored once from this size.
LEAST_REVISIT = 1000
DATE = "1970-01-01T00:00:00Z"
PAGE_URN = "urn:page:"


def _line(value: str | None) -> str:
    """A header's value: line ends and other control characters are percent-encoded, so that no value makes a header."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value or "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit has no payload but the digest and size of the one that it refers to."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{PAGE_URN}{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_line(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{PAGE_URN}{refers_to}>"]
    body = b"" if revisit else payload
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, end) of the record at an offset."""
    stop = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:stop].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no record at {at}")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    begin = stop + 4
    end = begin + int(headers["Content-Length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at {at} has another length than it says")
    return headers, data[begin:end], end + 4


class Bundle:
    """Collects records; bytes() is the finished bundle."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.frame_bytes, self.coder = frame_bytes, zstandard.ZstdCompressor(level=level)
        self.out, self.frames, self.index, self.frame = io.BytesIO(), [], [], []
        self.size = self.records = 0

    def add(self, key: int | None, data: bytes) -> None:
        self.index.append((key, len(self.frames), self.size, len(data)))
        self.frame.append(data)
        self.size += len(data)
        self.records += 1
        if self.size >= self.frame_bytes:
            self._close()

    def _close(self) -> None:
        if self.frame:
            packed = self.coder.compress(b"".join(self.frame))
            self.out.write(packed)
            self.frames.append((len(packed), self.size))
            self.frame, self.size = [], 0

    def length(self) -> int:
        return self.out.tell() + self.size

    def bytes(self) -> bytes:
        self._close()
        table = b"".join(struct.pack("<?qIQQ", k is not None, k or 0, f, o, n) for k, f, o, n in self.index)
        table = struct.pack("<II", TABLE_MAGIC, len(table)) + table
        self.out.write(table)
        # The seekable format counts its frames from the start: the skippable frame is one of them, of no plain bytes.
        frames = [*self.frames, (len(table), 0)]
        seek = b"".join(struct.pack("<II", *x) for x in frames) + struct.pack("<IBI", len(frames), 0, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE, len(seek)) + seek)
        return self.out.getvalue()


class Reader:
    """Random access to a bundle by record identifier."""

    def __init__(self, data: bytes):
        self.data = data
        n, _, magic = struct.unpack_from("<IBI", data, len(data) - 9)
        if magic != SEEK_MAGIC:
            raise ValueError("no seek table at the end")
        at = len(data) - 9 - 8 * n
        if struct.unpack_from("<II", data, at - 8) != (SKIPPABLE, 8 * n + 9):
            raise ValueError("the seek table has another length than its frame says")
        self.frames, self.starts, offset = [], [], 0
        for k in range(n):
            packed, plain = struct.unpack_from("<II", data, at + 8 * k)
            self.frames.append((packed, plain))
            self.starts.append(offset)
            offset += packed
        self.index = []
        table, size = self.starts[-1] + 8, self.frames[-1][0] - 8
        for k in range(0, size, struct.calcsize("<?qIQQ")):
            known, key, *place = struct.unpack_from("<?qIQQ", data, table + k)
            self.index.append((key if known else None, *place))
        self.places = {k: place for k, *place in reversed(self.index)}
        self._open: tuple[int, bytes] = (-1, b"")
        self.coder = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> bytes:
        if self._open[0] != k:
            packed, plain = self.frames[k]
            self._open = k, self.coder.decompress(self.data[self.starts[k] : self.starts[k] + packed], max_output_size=max(plain, 1))
        return self._open[1]

    def get(self, key: int | None) -> bytes:
        """The record of an identifier, the first of several."""
        f, o, n = self.places[key]
        return self.frame(f)[o : o + n]

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        for _, f, o, n in self.index:
            headers, block, end = parse(self.frame(f), o)
            if end != o + n:
                raise ValueError("a record has another length than the index says")
            yield headers, block


def planned(df: DataFrame, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html") -> DataFrame:
    """id, url, payload (binary), digest and refers_to of every row: of equal payloads of LEAST_REVISIT bytes or more the largest id is referred to by the others.

    Digests are counted before they meet, and only digests that occur again are joined back, to rows
    without payloads; payloads move once, by id and digest. Rows that share an id are judged each by its own
    payload, so equal rows are all responses or all revisits; a revisit means the payload of its digest
    among those of the id referred to. Rows without an id are responses.
    """
    payload = F.coalesce(F.col(payload_column).cast("string").cast("binary"), F.lit(b""))
    rows = df.select(F.col(id_column).cast("bigint").alias("id"), F.col(url_column).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    light = rows.where((F.octet_length("payload") >= LEAST_REVISIT) & F.col("id").isNotNull()).select("id", "digest")
    again = light.groupBy("digest").agg(F.max("id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = light.join(again, "digest").where("id <> refers_to").select("id", "digest", "refers_to").distinct()
    return rows.join(revisits, ["id", "digest"], "left")


BUNDLES = "first_id bigint, n_records bigint, content binary"


def bundled(rows: DataFrame, bundle_bytes: int = BUNDLE_BYTES, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """planned() rows as bundles: first_id, n_records, content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, first = Bundle(frame_bytes), None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([bundle.records], pa.int64()), pa.array([bundle.bytes()], pa.binary())], ["first_id", "n_records", "content"])

        for batch in C.pieces(batches, "payload"):
            for page, url, payload, digest, to in zip(*(batch.column(k).to_pylist() for k in ("id", "url", "payload", "digest", "refers_to")), strict=True):
                first = page if not bundle.records else first
                bundle.add(page, record(page, url, payload, digest, to, to is not None))
                if bundle.length() >= bundle_bytes:
                    yield done()
                    bundle = Bundle(frame_bytes)
        if bundle.records:
            yield done()

    return rows.select("id", "url", "payload", "digest", "refers_to").mapInArrow(run, BUNDLES)


READ = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def records(bundles: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of bundles, in READ's columns. Digests of responses are made anew and must agree with the headers; a revisit's payload is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in READ.split(", ")]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        urn = lambda x: (int(v) if (v := x.strip("<>").removeprefix(PAGE_URN)) else None) if x else None
        for batch in batches:
            for content in batch.column("content"):
                out = []
                for h, block in Reader(content.as_py()):
                    digest, size, kind = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Length"]), h["WARC-Type"]
                    if kind == "response" and (hashlib.sha1(block).hexdigest(), len(block)) != (digest, size):
                        raise ValueError(f"{h['WARC-Record-ID']}: the payload isn't what its digest says")
                    out.append((urn(h["WARC-Record-ID"]), h["WARC-Target-URI"], size, digest, kind, urn(h.get("WARC-Refers-To")), block if payloads and kind == "response" else None))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)

    return bundles.select("content").mapInArrow(run, READ)


def archived(df: DataFrame, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html") -> DataFrame:
    """Writes every row of df as a record to bundles in the shared folder (a Parquet table of BUNDLES) and returns that table.

    A null payload is empty. A url is written with control characters percent-encoded, null as empty.
    Extra columns are not written.
    """
    return stored(bundled(planned(df, id_column, url_column, payload_column)), "bundles", compression="none", maxRecordsPerFile="1")
