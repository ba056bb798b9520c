"""Benchmark decontamination by a positional inverted index.

The index is partitioned by documents: a segment holds whole documents, its sorted distinct terms and
for each term the ascending positions. Segments are written to the shared folder and can be searched
again. A search takes the windows of the benchmark in blocks of bounded size, starts each window from
the positions of its rarest term in the segment, and intersects the other terms' lists, offset by
their place in the window, in order of rarity.

Words are the runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after lower-casing A-Z. Terms are 64-bit hashes.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm import columns as C
from tessella.llm.scratch import stored

#: Documents lie this many positions apart, so that no window and no neighbourhood reaches over.
GAP = 64
#: Bytes of benchmark text in a block: the bound of what a search sends to each task.
BLOCK_BYTES = 4 << 20
SEGMENT = "segment bigint, ids binary, id_nulls binary, first binary, terms binary, ptr binary, positions binary"


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(term of each word, first word of each document and the end)."""
    low = C.LOWER[data]
    starts, ends, first = C.tokens(low, offsets, C.ALNUM8)
    return C.range_hash(low, starts, ends), first


def indexed(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", terms: np.ndarray | None = None) -> DataFrame:
    """Segments of the index over all rows of df; `terms` (sorted) keeps the postings of those terms only, all others being of no use to a search for them.

    Ids must be integers or null; a null or empty text is a document without words. `segment` and the place
    in it are the key of a row once the segments are stored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for k, batch in enumerate(C.pieces(batches, "text")):
            hashes, first = words(*C.text_bytes(batch.column("text")))
            counts = np.diff(first)
            position = np.arange(len(hashes)) + GAP * np.repeat(np.arange(len(counts)), counts)
            if terms is not None:
                at = np.minimum(np.searchsorted(terms, hashes), max(len(terms) - 1, 0))
                keep = terms[at] == hashes if len(terms) else np.zeros(len(hashes), bool)
                hashes, position = hashes[keep], position[keep]
            order = np.argsort(hashes, kind="stable")
            hashes, position = hashes[order], position[order]
            starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
            ids = batch.column("id")
            blobs = [np.asarray(ids.fill_null(0), np.int64), np.asarray(ids.is_null()), first, hashes[starts], np.append(starts, len(hashes)), position.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array([task + k]), *(pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in blobs)], ["segment", "ids", "id_nulls", "first", "terms", "ptr", "positions"])
        C.trim()

    return df.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text")).mapInArrow(run, SEGMENT)


class Segment:
    def __init__(self, row: dict):
        self.key = row["segment"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.nulls = np.frombuffer(row["id_nulls"], bool)
        self.first = np.frombuffer(row["first"], np.int64)
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.ptr = np.frombuffer(row["ptr"], np.int64)
        self.positions = np.frombuffer(row["positions"], np.int32).astype(np.int64)
        #: Every posting as one number, ascending: the term's rank, then the position.
        self.keys = np.repeat(np.arange(len(self.terms)) << 33, np.diff(self.ptr)) + self.positions
        #: Position of each document's first word.
        self.base = self.first[:-1] + GAP * np.arange(len(self.ids))

    def phrases(self, terms: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, position) of every exact occurrence. terms: a row for each window, size[w] of them count."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.terms) or not len(terms):
            return none
        inside = np.arange(terms.shape[1]) < size[:, None]
        rank = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        window = np.flatnonzero(((self.terms[rank] == terms) | ~inside).all(1))
        if not len(window):
            return none
        rank, inside = rank[window], inside[window]
        rarity = np.where(inside, self.ptr[rank + 1] - self.ptr[rank], np.iinfo(np.int64).max)
        order = np.argsort(rarity, 1, kind="stable")
        lead = order[:, 0]
        lead_rank = rank[np.arange(len(window)), lead]
        own, nth = C.expand(self.ptr[lead_rank + 1] - self.ptr[lead_rank])
        start = self.positions[self.ptr[lead_rank][own] + nth] - lead[own]
        for j in range(1, terms.shape[1]):
            if not len(own):
                break
            place = order[own, j]
            need = inside[own, place]
            key = (rank[own, place] << 33) + start + place
            hit = self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] == key
            keep = (hit | ~need) & (start >= 0)
            own, start = own[keep], start[keep]
        return window[own], start

    def near(self, terms: np.ndarray, size: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, position of its rarest term) where every term of the window lies within size + slop words of that term in the same document, in any order."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.terms) or not len(terms):
            return none
        inside = np.arange(terms.shape[1]) < size[:, None]
        rank = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        window = np.flatnonzero(((self.terms[rank] == terms) | ~inside).all(1))
        rank, inside = rank[window], inside[window]
        rarity = np.where(inside, self.ptr[rank + 1] - self.ptr[rank], np.iinfo(np.int64).max)
        order = np.argsort(rarity, 1, kind="stable")
        lead_rank = rank[np.arange(len(window)), order[:, 0]]
        own, nth = C.expand(self.ptr[lead_rank + 1] - self.ptr[lead_rank])
        at = self.positions[self.ptr[lead_rank][own] + nth]
        reach = np.minimum(size[window] + slop - 1, GAP - 1)
        for j in range(1, terms.shape[1]):
            place = order[own, j]
            need = inside[own, place]
            low = (rank[own, place] << 33) + np.maximum(at - reach[own], 0)
            got = self.keys[np.minimum(np.searchsorted(self.keys, low), len(self.keys) - 1)]
            keep = ((got >= low) & (got <= (rank[own, place] << 33) + at + reach[own])) | ~need
            own, at = own[keep], at[keep]
        return window[own], at


def windows(items: pd.DataFrame, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct windows of a block of items: (terms, size, first, items, unnamed), items[first[w]:first[w+1]] naming those that hold window w, and unnamed[w] saying that one without an id does."""
    data, offsets = C.text_bytes(pa.array(items["text"], pa.string()))
    hashes, first = words(data, offsets)
    counts = np.diff(first)
    own, nth = C.expand(np.where(counts >= length, counts - length + 1, (counts > 0).astype(np.int64)))
    size = np.minimum(counts[own], length)
    place = np.arange(length)
    rows = np.where(place < size[:, None], hashes[np.minimum(first[own][:, None] + nth[:, None] + place, max(len(hashes) - 1, 0))] if len(hashes) else np.uint64(0), np.uint64(0))
    if not len(rows):
        return np.zeros((0, length), np.uint64), np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    both, inverse = np.unique(np.concatenate([rows, size[:, None].astype(np.uint64)], 1), axis=0, return_inverse=True)
    named = items["named"].to_numpy(bool)[own] if "named" in items else np.ones(len(own), bool)
    pairs = np.unique(np.stack([inverse.ravel()[named], items["id"].to_numpy(np.int64)[own][named]], 1), axis=0)
    unnamed = np.zeros(len(both), bool)
    unnamed[inverse.ravel()[~named]] = True
    return both[:, :-1], both[:, -1].astype(np.int64), np.searchsorted(pairs[:, 0], np.arange(len(both) + 1)), pairs[:, 1], unnamed


def blocks(benchmark: DataFrame, id_column: str, text_column: str, block_bytes: int) -> Iterator[pd.DataFrame]:
    """The benchmark in blocks of about block_bytes of text, each item in one: id, text, named. Items without a text have no windows and go; those without an id have 0 and are not named."""
    id_ = F.col(id_column).cast("bigint")
    items = benchmark.where(F.col(text_column).isNotNull()).select(F.coalesce(id_, F.lit(0).cast("bigint")).alias("id"), F.col(text_column).alias("text"), id_.isNotNull().alias("named"))
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = -(-total // block_bytes)
    for k in range(n):
        yield items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).toPandas()


def searched(segments: DataFrame, items: pd.DataFrame, length: int = 10, slop: int | None = None) -> DataFrame:
    """Documents of the index against one block of items: segment, place, id, n_words, `starts` and `ends` (word ranges hit, disjoint and ascending), `items` (ascending) and `unnamed` (whether an item without an id is there). Every document has a row.

    With slop the matches are proximity matches: the ranges then hold the rarest term's word only.
    """
    terms, size, first, own_items, unnamed = windows(items, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                s = Segment(row)
                window, start = s.phrases(terms, size) if slop is None else s.near(terms, size, slop)
                span = size[window] if slop is None else np.ones(len(window), np.int64)
                n, counts = len(s.ids), np.diff(s.first)
                doc = np.searchsorted(s.base, start, "right") - 1
                # Equal bases: documents without words lie GAP apart, so bases ascend strictly.
                cover = np.zeros(int(s.base[-1] + counts[-1]) + 2 if n else 1, np.int64)
                np.add.at(cover, start, 1)
                np.add.at(cover, start + span, -1)
                edge = np.diff(np.concatenate([[0], (np.cumsum(cover) > 0).astype(np.int8), [0]]))
                a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                runs = np.searchsorted(a, np.append(s.base, len(cover)))
                hit_doc = np.searchsorted(s.base, a, "right") - 1
                a, b = (a - s.base[hit_doc]).tolist(), (b - s.base[hit_doc]).tolist()
                got, nth = C.expand(first[window + 1] - first[window])
                pairs = np.unique(np.stack([doc[got], own_items[first[window][got] + nth]], 1), axis=0) if len(window) else np.zeros((0, 2), np.int64)
                cut = np.searchsorted(pairs[:, 0], np.arange(n + 1))
                listed = pairs[:, 1].tolist()
                nameless = np.zeros(n, bool)
                nameless[doc[unnamed[window]]] = True
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, s.key, np.int64)),
                        pa.array(np.arange(n)),
                        pa.array(s.ids, mask=s.nulls),
                        pa.array(counts),
                        pa.array([a[x:y] for x, y in zip(runs[:-1], runs[1:], strict=True)], pa.list_(pa.int64())),
                        pa.array([b[x:y] for x, y in zip(runs[:-1], runs[1:], strict=True)], pa.list_(pa.int64())),
                        pa.array([listed[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.list_(pa.int64())),
                        pa.array(nameless),
                    ],
                    ["segment", "place", "id", "n_words", "starts", "ends", "items", "unnamed"],
                )

    return segments.mapInArrow(run, "segment bigint, place bigint, id bigint, n_words bigint, starts array<bigint>, ends array<bigint>, items array<bigint>, unnamed boolean")


def total(starts: Column, ends: Column) -> Column:
    return F.coalesce(F.aggregate(F.arrays_zip(starts.alias("s"), ends.alias("e")), F.lit(0).cast("bigint"), lambda t, x: t + x["e"] - x["s"]), F.lit(0).cast("bigint"))


def _union_size(spans: Column) -> Column:
    """Words in ascending spans that may overlap."""
    zero = F.lit(0).cast("bigint")
    return F.aggregate(spans, F.struct(zero.alias("n"), zero.alias("to")), lambda t, x: F.struct((t["n"] + F.greatest(zero, x["e"] - F.greatest(x["s"], t["to"]))).alias("n"), F.greatest(t["to"], x["e"]).alias("to")), lambda t: t["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, length: int = 10, id_column: str = "doc_id", text_column: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id, n_words, n_hit (words in any occurrence of a window), items (array, ascending), unnamed (whether an item without an id occurs) for every row of docs.

    A window is `length` consecutive words of an item; an item of fewer, but not none, is one window.
    Null and empty texts have no words. Repeated rows and null ids each get a row, however many blocks the
    benchmark needs. Items without an id count in n_hit as others do and only have no name in items; items
    of one id are one. Extra columns are not read.
    """
    if not 0 < length <= GAP:
        raise ValueError(f"length: from 1 to {GAP}")
    parts = blocks(benchmark, item_id, item_text, block_bytes)
    first = next(parts, pd.DataFrame({"id": np.zeros(0, np.int64), "text": np.zeros(0, object), "named": np.zeros(0, bool)}))
    second = next(parts, None)
    if second is None:
        wanted = np.unique(words(*C.text_bytes(pa.array(first["text"], pa.string())))[0])
        segments = stored(indexed(docs, id_column, text_column, wanted), "postings", maxRecordsPerFile="16")
        out = searched(segments, first, length).select("id", "n_words", total(F.col("starts"), F.col("ends")).alias("n_hit"), "items", "unnamed")
    else:
        # One index for all blocks; each block's hits are written, and only one block is held at a time.
        segments = stored(indexed(docs, id_column, text_column), "postings", maxRecordsPerFile="16")
        every = searched(segments, first, length)
        for part in itertools.chain([second], parts):
            every = every.unionByName(stored(searched(segments, part, length).where(F.size("starts") > 0), "hits"))
        spans = F.array_sort(F.flatten(F.collect_list(F.transform(F.arrays_zip(F.col("starts").alias("s"), F.col("ends").alias("e")), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))))))
        out = every.groupBy("segment", "place").agg(F.max("id").alias("id"), F.max("n_words").alias("n_words"), _union_size(spans).alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("unnamed").alias("unnamed")).drop("segment", "place")
    return out.withColumnRenamed("id", id_column)
