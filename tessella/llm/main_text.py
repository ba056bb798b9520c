"""Main text of web pages: structure of the page, and a suffix array over the pages of a host.

A page is cut into blocks, and its markup says of each whether it stands in the article, in the page's
furniture or in neither. The word streams of a host's pages are put one after another, and a suffix array
finds the runs of MIN_WORDS words and more that distinct pages share. Both together decide:

* On a page without a marked article, a block outside the furniture goes if COVERED percent of its words
  lie in common runs: those that MIN_PAGES distinct pages of the host have (or both, where it has two).
* Where only names in the markup (classes, ids) hint at the article, a block in it goes if all its words lie
  in common runs, and what lies outside it goes.
* An article marked by an element or a role keeps all its blocks, quotations and copies too; what lies
  outside it goes.

Pages whose longest block is the same are copies of one text and count as one page: neither equal nor
nearly equal pages make each other's text common. Of a page's blocks those in its furniture don't count as
the longest.

Hosts meet in shards of bounded size. Pages of a large host are dealt to several shards by page; those
shards then tell each other, through buckets, the hashes of their runs of MIN_WORDS words and which texts
have them. Every page goes through one suffix array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import columns as C
from tessella.llm.html_blocks import CHROME, LIKELY, MAIN, OPEN, blocks
from tessella.llm.suffix_array import common_prefixes, suffix_array

MIN_WORDS = 6
#: Distinct pages that make a run common, and the part of an unmarked block's words, in percent, from which common runs make it boilerplate.
MIN_PAGES = 3
COVERED = 50
#: Page source of a shard, and run hashes of a bucket: what one task holds.
SHARD_BYTES = 8 << 20
BUCKET_RUNS = 2 << 20

PACKED = "g bigint, pages binary"
EXTRACTED = "id bigint, url string, text string, n_chars bigint, n_blocks bigint, n_common_blocks bigint, n_shared_words bigint, unique_text string"
PAGE = pa.schema([("id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("large", pa.bool_()), ("texts", pa.list_(pa.string())), ("places", pa.list_(pa.int8()))])
PLACES = [CHROME, OPEN, LIKELY, MAIN]
#: Page source whose parsed pages are compressed together, and bytes of a run's hash that buckets compare beside its bucket.
PACK_BYTES = 6 << 20
KEY_BYTES = 5


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages in blocks, by shard: rows of PACKED, each a compressed table of PAGE."""
    for batch in C.pieces(batches, "html", PACK_BYTES):
        found = [blocks(x) for x in batch.column("html").to_pylist()]
        texts = pa.array([[t for t, _ in x] for x in found], pa.list_(pa.string()))
        places = pa.array([[PLACES.index(p) for _, p in x] for x in found], pa.list_(pa.int8()))
        pages = pa.table([batch.column("id"), batch.column("url"), batch.column("host"), pc.greater(batch.column("k"), 1), texts, places], schema=PAGE)
        g = np.asarray(batch.column("g"), np.int64)
        order = np.argsort(g, kind="stable")
        names, first = np.unique(g[order], return_index=True)
        blobs = []
        for rows in np.split(order, first[1:]):
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, PAGE, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(pages.take(rows).combine_chunks())
            blobs.append(out.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(blobs, pa.binary())], ["g", "pages"])


def _unpacked(table: pa.Table) -> pa.Table:
    parts = [pa.ipc.open_stream(x).read_all() for x in table.column("pages").to_pylist()]
    return pa.concat_tables(parts).combine_chunks() if parts else PAGE.empty_table()


class Shard:
    """Words of a shard's pages and their windows of min_words words.

    Of each window, over the pages that were compared: how many texts hold it (`texts`, at most MIN_PAGES) and
    the first two (`text` and `text2`, a byte of their hashes). `common` is what decides.
    """

    def __init__(self, pages: pa.Table, min_words: int):
        self.pages, self.width = pages, min_words
        texts = pages.column("texts").combine_chunks() if pages.num_rows else pa.array([], pa.list_(pa.string()))
        places = pages.column("places").combine_chunks() if pages.num_rows else pa.array([], pa.list_(pa.int8()))
        counts = np.asarray(pc.list_value_length(texts), np.int64)
        self.data, self.offsets = C.text_bytes(texts.flatten())
        self.place = np.asarray(places.flatten(), np.int8)
        self.starts, self.ends, self.block_first = C.tokens(self.data, self.offsets, C.NOT_SPACE6)
        self.page_block = np.concatenate([[0], np.cumsum(counts)])
        self.page_word = self.block_first[self.page_block]
        self.host = np.array([hash_text(x) for x in pages.column("host").to_pylist()], np.uint64)
        own = np.repeat(np.arange(len(counts)), np.diff(self.page_word))
        self.words = C.mix(C.range_hash(self.data, self.starts, self.ends) ^ self.host[own])
        self.page, nth = C.expand(np.maximum(np.diff(self.page_word) - min_words + 1, 0))
        self.window = self.page_word[self.page] + nth
        self.text_of = self._longest(counts)
        n = len(self.window)
        self.texts, self.text, self.text2 = np.ones(n, np.int8), np.zeros(n, np.uint8), np.zeros(n, np.uint8)
        self.common = np.zeros(n, bool)
        self.large = np.asarray(pages.column("large").to_pandas(), bool)

    def _longest(self, counts: np.ndarray) -> np.ndarray:
        """A hash of the longest block (the first of several) outside the furniture of each page; of all, where it has none."""
        block = np.repeat(np.arange(len(counts)), counts)
        size = np.diff(self.offsets) + (self.place != 0) * (1 << 40)
        order = np.lexsort((-np.arange(len(size)), size, block))
        last = np.cumsum(counts)[counts > 0] - 1
        out = np.zeros(len(counts), np.uint64)
        best = order[last]
        out[counts > 0] = C.range_hash(self.data, self.offsets[best], self.offsets[best + 1])
        return C.mix(out ^ self.host)

    def compare(self, pages: np.ndarray) -> None:
        """Counts the texts of each window among the given pages (a mask), by a suffix array over their words, page after page with a separator."""
        counts = np.diff(self.page_word)
        own = np.repeat(np.arange(len(counts)), counts)
        use = pages[own]
        if not use.any():
            return
        _, ids = np.unique(self.words[use], return_inverse=True)
        place = np.full(len(own), -1, np.int64)
        before = np.cumsum(pages) - 1
        place[use] = np.arange(len(ids)) + before[own[use]]
        text = np.zeros(len(ids) + int(pages.sum()), np.int64)
        text[place[use]] = ids + 1
        order = suffix_array(text, self.width)
        group = np.empty(len(text), np.int64)
        group[order] = np.cumsum(common_prefixes(text, order, self.width) < self.width)
        mine = np.flatnonzero(pages[self.page])
        group = group[place[self.window[mine]]]
        n = len(text) + 1
        copy = self.text_of[self.page[mine]]
        by = np.lexsort((copy, group))
        fresh = np.ones(len(by), bool)
        fresh[1:] = (group[by][1:] != group[by][:-1]) | (copy[by][1:] != copy[by][:-1])
        first = by[fresh]
        some = np.bincount(group[first], minlength=n)
        one, two = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
        named, at = np.unique(group[first], return_index=True)
        two_at = np.minimum(at + 1, max(len(first) - 1, 0))
        byte = (copy[first] & np.uint64(255)).astype(np.uint8)
        one[named], two[named] = byte[at], byte[two_at]
        self.texts[mine] = np.minimum(some, MIN_PAGES)[group]
        self.text[mine], self.text2[mine] = one[group], two[group]

    def settle(self, least: np.ndarray) -> None:
        """`least`: for each page the texts that make a run common."""
        self.common = self.texts >= least[self.page]

    def host_texts(self) -> np.ndarray:
        """For each page the distinct texts of its host here."""
        pairs = np.unique(np.stack([self.host, self.text_of], 1), axis=0) if len(self.host) else np.zeros((0, 2), np.uint64)
        names, counts = np.unique(pairs[:, 0], return_counts=True)
        return counts[np.searchsorted(names, self.host)] if len(names) else np.zeros(0, np.int64)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """(places in window, hashes) of the windows of large hosts' pages."""
        at = np.flatnonzero(self.large[self.page]) if len(self.page) else np.zeros(0, np.int64)
        return at, C.window_hash(self.words, self.window[at], np.full(len(at), self.width))

    def extracted(self) -> pa.Table:
        cover = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(cover, self.window[self.common], 1)
        np.add.at(cover, self.window[self.common] + self.width, -1)
        covered = np.cumsum(cover)[:-1] > 0
        hits, sizes = C.per_owner(self.block_first, covered), np.diff(self.block_first)
        # The best mark on a page says which of its blocks are asked: those with it.
        counts = np.diff(self.page_block)
        best = np.ones(len(counts), np.int8)
        np.maximum.at(best, np.repeat(np.arange(len(counts)), counts), self.place)
        asked = self.place == np.repeat(best, counts)
        share = np.array([0, COVERED, 100, 101])[self.place]
        common = 100 * hits >= share * np.maximum(1, sizes)
        keep, dropped = asked & ~common, asked & common
        raw, rows = self.data.tobytes(), []
        for p in range(self.pages.num_rows):
            lo, hi = int(self.page_block[p]), int(self.page_block[p + 1])
            kept = (lo + np.flatnonzero(keep[lo:hi])).tolist()
            text = "\n".join(raw[self.offsets[b] : self.offsets[b + 1]].decode() for b in kept)
            alone = []
            for b in kept:
                i, j = self.block_first[b], self.block_first[b + 1]
                if not hits[b]:
                    alone.append(raw[self.offsets[b] : self.offsets[b + 1]].decode())
                elif hits[b] < j - i:
                    alone.append(" ".join(raw[self.starts[w] : self.ends[w]].decode() for w in range(i, j) if not covered[w]))
            rows.append((text, len(text), len(kept), int(dropped[lo:hi].sum()), int(hits[kept].sum()), "\n".join(alone)))
        types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.table([self.pages.column("id"), self.pages.column("url"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], names=[x.split()[0] for x in EXTRACTED.split(", ")])


def hash_text(text: str | None) -> int:
    data = np.frombuffer((text or "").encode() or b"\0", np.uint8)
    return int(C.range_hash(data, np.array([0]), np.array([len(data)]))[0])


def _dealt(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys by bucket and value, edges of the buckets, place of each key among them)."""
    distinct, inverse = np.unique(keys, return_inverse=True)
    bucket = ((distinct & np.uint64(0xFFFFFF)) % np.uint64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return distinct[order], np.searchsorted(bucket[order], np.arange(n + 1)), place[inverse]


def _bits(flags: np.ndarray, edges: np.ndarray, rows: list[int]) -> pa.Array:
    return pa.array([np.packbits(flags[edges[b] : edges[b + 1]]).tobytes() for b in rows], pa.binary())


ASKED = "g bigint, b bigint, keys binary, texts binary, second binary, two binary, enough binary"


def _ask(min_words: int, n: int):
    """Of the pages of large hosts, which alone are looked at here: for each bucket the runs' hashes, a text that holds each, another one where two do here (`two`), and whether MIN_PAGES do (`enough`)."""

    def run(table: pa.Table) -> pa.Table:
        pages = _unpacked(table)
        s = Shard(pages.filter(pages.column("large")).combine_chunks(), min_words)
        s.compare(s.large)
        at, keys = s.keys()
        distinct, edges, place = _dealt(keys, n)
        head = np.zeros(len(distinct), np.int64)
        head[place] = at
        texts, one, other = s.texts[head], s.text[head], s.text2[head]
        two = (texts > 1) & (texts < MIN_PAGES)
        short = (distinct >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
        rows = [b for b in range(n) if edges[b] < edges[b + 1]]
        cut = lambda x: pa.array([x[edges[b] : edges[b + 1]].tobytes() for b in rows], pa.binary())
        second = pa.array([other[edges[b] : edges[b + 1]][two[edges[b] : edges[b + 1]]].tobytes() for b in rows], pa.binary())
        g = table.column("g")[0].as_py()
        columns = [pa.array([g] * len(rows), pa.int64()), pa.array(rows, pa.int64()), cut(short), cut(one), second, *(_bits(x, edges, rows) for x in (two, texts >= MIN_PAGES))]
        return pa.table(columns, names=[x.split()[0] for x in ASKED.split(", ")])

    return run


def _answer(table: pa.Table) -> pa.Table:
    """For each shard a bit for each of its hashes: whether MIN_PAGES texts of all shards hold it."""
    parts = []
    for x in table.column("keys").to_pylist():
        wide = np.zeros((len(x) // KEY_BYTES, 8), np.uint8)
        wide[:, :KEY_BYTES] = np.frombuffer(x, np.uint8).reshape(-1, KEY_BYTES)
        parts.append(wide.view("<u8").ravel())
    unpacked = lambda k: np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)) for x, p in zip(table.column(k).to_pylist(), parts, strict=True)]).astype(bool)
    two, enough = (unpacked(k) for k in ("two", "enough"))
    text, second = (np.concatenate([np.frombuffer(x, np.uint8) for x in table.column(k).to_pylist()]) for k in ("texts", "second"))
    names, place = np.unique(np.concatenate(parts), return_inverse=True)
    # Distinct texts by a byte of their hashes.
    pairs = np.unique(np.concatenate([place << 8 | text, place[two] << 8 | second])) >> 8
    known = np.bincount(pairs, minlength=len(names)) >= MIN_PAGES
    known[place[enough]] = True
    ends = np.cumsum([len(p) for p in parts])
    cut = lambda x: pa.array([np.packbits(x[place[e - len(p) : e]]).tobytes() for p, e in zip(parts, ends, strict=True)], pa.binary())
    return pa.table({"g": table.column("g"), "b": table.column("b"), "common": cut(known)})


def _finish(min_words: int, n: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        s = Shard(_unpacked(table), min_words)
        s.compare(~s.large)
        s.settle(np.clip(s.host_texts(), 2, MIN_PAGES))
        at, keys = s.keys()
        distinct, edges, place = _dealt(keys, n)
        known = np.zeros(len(distinct), bool)
        for b, bits in zip(answers.column("b").to_pylist(), answers.column("common").to_pylist(), strict=True):
            known[edges[b] : edges[b + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(edges[b + 1] - edges[b]))
        s.common[at] = known[place]
        return s.extracted()

    return run


def _alone(min_words: int):
    def run(table: pa.Table) -> pa.Table:
        s = Shard(_unpacked(table), min_words)
        s.compare(np.ones(s.pages.num_rows, bool))
        s.settle(np.clip(s.host_texts(), 2, MIN_PAGES))
        return s.extracted()

    return run


#: Large hosts that are sent to every task; more of them are joined by name.
BROADCAST_HOSTS = 100_000


def extracted(df: DataFrame, min_words: int = MIN_WORDS, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """id, url, text, n_chars, n_blocks, n_common_blocks (left out for their common runs), n_shared_words (words of the text in common runs) and unique_text (the text without those runs) for every row of df.

    text has the blocks in page order that the rules above leave, joined by line feeds. A null or empty html
    has an empty text. Rows with one id are different pages, equal rows copies of one text. A null url is a
    host of its own with all other null ones. A large host is one that needs two shards or more: it has as many
    texts as MIN_PAGES for these rules. Ids are integers or null; extra columns are not read.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_column).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    pages = df.select(F.col(id_column).cast("bigint").alias("id"), F.col(url_column).cast("string").alias("url"), F.col(html_column).cast("string").alias("html"), host.alias("host"))
    sizes = pages.groupBy("host").agg(F.sum(F.coalesce(F.octet_length("html"), F.lit(0)) + 64).alias("bytes"))
    large = sizes.where(F.col("bytes") > shard_bytes).select("host", F.ceil(F.col("bytes") / shard_bytes).cast("bigint").alias("k"))
    total, most, several = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.max("bytes"), F.lit(0)), F.count(F.when(F.col("bytes") > shard_bytes, 1))).first()
    # More shards than needed: two large hosts seldom meet in one.
    n = max(1, -(-4 * total // shard_bytes))
    pages = pages.join(F.broadcast(large) if several <= BROADCAST_HOSTS else large, "host", "left").withColumn("k", F.coalesce("k", F.lit(1)).cast("bigint"))
    salt = F.pmod(F.xxhash64("id", F.substring("html", 1, 64)), F.col("k"))
    pages = pages.withColumn("g", F.pmod(F.xxhash64("host", salt), F.lit(n)))
    packed = pages.select("id", "url", "g", "host", "k", "html").mapInArrow(_parsed, PACKED)
    if most <= shard_bytes:
        out = packed.groupBy("g").applyInArrow(_alone(min_words), EXTRACTED)
    else:
        buckets = max(64, -(-total // 6 // BUCKET_RUNS))
        asked = packed.groupBy("g").applyInArrow(_ask(min_words, buckets), ASKED)
        answers = asked.groupBy("b").applyInArrow(_answer, "g bigint, b bigint, common binary")
        out = packed.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(_finish(min_words, buckets), EXTRACTED)
    return out.withColumnRenamed("id", id_column).withColumnRenamed("url", url_column)
