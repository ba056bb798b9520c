"""JSON objects of a byte log with their exact byte offsets.

Spark's text reader decodes lines and forgets where they were, so files are read whole as bytes
(`binaryFile`), and each is scanned in one Python call. A file is a segment or a generation: bounded by
what its writer appends, and far below the size of a binary value.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

MAX_LINE = 32 << 20
RECORDS = "path string, lineno bigint, offset bigint, length bigint, object string, error string"

_decoder = json.JSONDecoder()


def scan(data: bytes, max_line: int = MAX_LINE) -> Iterator[tuple[int, int, int, object, str | None]]:
    """(line, offset, length, object, error) for each object, several on one line too. A line that breaks off after an object reports what is left of it; an overlong line is not parsed."""
    at, lineno = 0, 0
    while at < len(data):
        lineno += 1
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        start, at = at, end + 1
        if lineno == 1 and data.startswith(b"\xef\xbb\xbf"):
            start += 3
        line = data[start:end]
        if not line.strip():
            continue
        if len(line) > max_line:
            yield lineno, start, len(line), None, "line_too_long"
            continue
        text = line.decode("utf-8", "surrogateescape")
        place = byte = found = 0
        while True:
            rest = len(text) - len(text[place:].lstrip(" \t\r\n\f\v"))
            byte += len(text[place:rest].encode("utf-8", "surrogateescape"))
            place = rest
            if place >= len(text):
                break
            try:
                value, stop = _decoder.raw_decode(text, place)
            except (ValueError, RecursionError):
                yield lineno, start + byte, len(line) - byte, None, "json_decode_truncated" if found else "json_decode_error"
                break
            size = len(text[place:stop].encode("utf-8", "surrogateescape"))
            yield lineno, start + byte, size, value, None
            found += 1
            place, byte = stop, byte + size


def records(files: DataFrame, max_line: int = MAX_LINE) -> DataFrame:
    """RECORDS of files (path, content): an object as JSON text, or an error in its place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = [(path, n, o, k, None if e else json.dumps(v), e) for n, o, k, v, e in scan(bytes(content or b""), max_line)]
                yield pd.DataFrame(rows, columns=["path", "lineno", "offset", "length", "object", "error"])

    return files.select("path", "content").mapInPandas(run, RECORDS)


def files(spark: SparkSession, root: str, glob: str = "*.jsonl") -> DataFrame:
    """path, length, content of all files under root."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)


def read_span(content, offset, length):
    """Bytes of a binary column."""
    from pyspark.sql import functions as F

    return F.substring(content, offset.cast("int") + 1, length.cast("int"))
