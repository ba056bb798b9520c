"""Token counts by section: offset-mapped attribution.

Every document is encoded once, whole. The character spans of its tokens meet the spans of its sections
in an interval join of two ascending lists, and a token that lies over a boundary is allocated by a rule
that is stated: to the section of its first character, to that of the larger part (the earlier one of
equal parts), or in proportion.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import columns as C

RULES = ("first", "majority", "proportional")
COUNTED = "section bigint, start bigint, end bigint, n_tokens double, n_crossing bigint"


@lru_cache(2)
def ranks(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        known = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    sizes = np.zeros(max(known.values()) + 1, np.int64)
    for token, rank in known.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={}), sizes


def paragraphs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, first section of each document and the end): sections end with a run of line feeds; an empty text is one section."""
    feed = data == 10
    after = np.zeros(len(data) + 1, bool)
    after[1:-1] = feed[:-1] & ~feed[1:]
    after[offsets] = False
    inner = np.flatnonzero(after)
    starts = np.sort(np.concatenate([offsets[:-1], inner]), kind="stable")
    return starts, np.searchsorted(inner, offsets) + np.arange(len(offsets))


def attribute(tokens: np.ndarray, sections: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens by section, crossing tokens by section of the first byte). Both lists hold ascending edges from 0 to the same end; sections may be empty."""
    n = len(sections) - 1
    starts, ends = tokens[:-1], tokens[1:]
    a = np.searchsorted(sections, starts, "right") - 1
    b = np.searchsorted(sections, ends, "left") - 1
    crossing = np.bincount(a[b > a], minlength=n)
    if rule == "first":
        return np.bincount(a, minlength=n).astype(float), crossing
    own, nth = C.expand(b - a + 1)
    part = a[own] + nth
    share = np.minimum(sections[part + 1], ends[own]) - np.maximum(sections[part], starts[own])
    if rule == "proportional":
        return np.bincount(part, share / (ends - starts)[own], n), crossing
    order = np.lexsort((part, -share, own))
    head = np.ones(len(order), bool)
    head[1:] = own[order][1:] != own[order][:-1]
    return np.bincount(part[order[head]], minlength=n).astype(float), crossing


def counted(df: DataFrame, ranks_path: str, rule: str = "first", id_column: str = "doc_id", text_column: str = "text", sections: Callable = paragraphs) -> DataFrame:
    """id and `sections` (array of structs, COUNTED, in text order; start and end are code points) for every row of df.

    A null or empty text is one empty section without tokens. Equal rows each get a row, a null id stays
    null, extra columns are not read. The counts of a document add up to the tokens of its whole text.
    """
    if rule not in RULES:
        raise ValueError(f"rule: one of {', '.join(RULES)}")
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, sizes = ranks(ranks_path)
        for batch in C.pieces(batches, "text"):
            data, offsets = C.text_bytes(batch.column("text"))
            starts, first = sections(data, offsets)
            chars = np.zeros(len(data) + 1, np.int64)
            np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
            raw = data.tobytes()
            out = [[], [], [], [], []]
            for d in range(len(offsets) - 1):
                lo, hi = int(offsets[d]), int(offsets[d + 1])
                edges = np.append(starts[first[d] : first[d + 1]], hi) - lo
                found = np.frombuffer(encoding.encode_to_numpy(raw[lo:hi].decode(errors="replace"), allowed_special=set(), disallowed_special=()), np.uint32) if hi > lo else np.zeros(0, np.uint32)
                counts, crossing = attribute(np.concatenate([[0], np.cumsum(sizes[found])]), edges, rule)
                point = chars[edges + lo] - chars[lo]
                for column, x in zip(out, (np.arange(len(counts)), point[:-1], point[1:], counts, crossing), strict=True):
                    column.append(x)
            names = [x.split()[0] for x in COUNTED.split(", ")]
            flat = pa.StructArray.from_arrays([pa.array(np.concatenate(x).astype(float if n == "n_tokens" else np.int64)) for n, x in zip(names, out, strict=True)], names)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), flat)], ["id", "sections"])

    got = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(run, f"id {kind}, sections array<struct<{COUNTED.replace(' ', ':').replace(',:', ',')}>>")
    return got.withColumnRenamed("id", id_column)
