"""Removal of byte strings that occur more than once: per-shard suffix arrays.

A string of `width` bytes that starts at two places is found at both, whichever documents they are in.
Every window of that width names one anchor, the GRAM bytes in it of the smallest hash, so equal windows
name equal anchors at equal places. Neighbouring windows with one anchor are a run, and the bytes under
it are its context.

1. Groups of documents send the hashes of their runs' anchors and contexts, packed, to buckets by anchor.
   An anchor that occurs once settles its run as unique; a context that occurs again settles it as
   repeated.
2. What is left are contexts that agree in part. Each different one goes once, as bytes, to a shard by
   anchor. A shard builds a suffix array of its contexts by Larsson-Sadakane refinement, and Kasai's
   common prefixes of neighbours tell the repeated windows.
3. An anchor with very many contexts is dealt to several shards. These are merged by sorted arrays: each
   sends one window of a kind, as a 128-bit digest, to as many buckets as the anchor has shards, packed
   and in order, and a bucket looks every shard's array up by binary search among those of all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import columns as C
from tessella.llm.scratch import stored
from tessella.llm.suffix_array import common_prefixes, suffix_array

GRAM = 32
#: Text of a group, runs of a bucket, context bytes of a shard and contexts of one anchor in it: what one task holds.
GROUP_BYTES = 2 << 20
BUCKET_RUNS = 1 << 20
SHARD_BYTES = 2 << 20
SHARD_CONTEXTS = 4096
#: Bytes that are hashed at once; longer texts go in stretches that overlap by a window.
STRETCH = 1 << 22
_PLACE = np.uint64((1 << 23) - 1)

UNIQUE, REPEATED, PARTIAL, MODEL = range(4)
#: Sixteen bytes that compare byte for byte.
DIGEST = np.dtype("S16")


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each byte on."""
    part = C.mix(C.chunks(data)[: len(data) - 7] + np.uint64(0x2545F4914F6CDD1D))
    n, out = len(data) - GRAM + 1, np.uint64(0)
    for k in range(0, GRAM, 8):
        out = C.mix(out ^ part[k : k + n])
    return out


def _stretch_runs(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    span = width - GRAM + 1
    n = len(data)
    sizes = np.diff(offsets)
    if n < width or not (sizes >= width).any():
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    gram = _grams(data)
    low = gram & ~_PLACE | np.arange(len(gram), dtype=np.uint64)
    reach = 1
    while 2 * reach <= span:
        low = np.minimum(low[: len(low) - reach], low[reach:])
        reach *= 2
    if span > reach:
        low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
    own, nth = C.expand(np.maximum(sizes - width + 1, 0))
    window = offsets[own] + nth
    anchor = (low[window] & _PLACE).astype(np.int64)
    head = np.ones(len(window), bool)
    head[1:] = (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1])
    head = np.flatnonzero(head)
    first, last = window[head], window[np.append(head[1:], len(window)) - 1]
    anchor = anchor[head]
    context = C.mix(C.range_hash(data, first, last + width) ^ C.mix((anchor - first).astype(np.uint64)))
    return own[head], first - offsets[own[head]], last - offsets[own[head]], gram[anchor], context


def runs(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(document, first window, last window, anchor hash, context hash) of every run, in text order."""
    sizes = np.diff(offsets)
    if len(data) <= STRETCH:
        return _stretch_runs(data, offsets, width)
    out = []
    for d in range(len(sizes)):
        for a in range(0, max(int(sizes[d]) - width + 1, 1), STRETCH - width):
            b = min(a + STRETCH - 1, int(sizes[d]))
            own, first, last, anchor, context = _stretch_runs(data[offsets[d] + a : offsets[d] + b], np.array([0, b - a]), width)
            out.append((own + d, first + a, last + a, anchor, context))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _sorted_pairs(anchor: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, context, count, index of the first, place of each row) of the distinct pairs, ascending."""
    order = np.lexsort((context, anchor))
    a, c = anchor[order], context[order]
    head = np.ones(len(a), bool)
    head[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
    place = np.empty(len(a), np.int64)
    place[order] = np.cumsum(head) - 1
    at = np.flatnonzero(head)
    return a[at], c[at], np.diff(np.append(at, len(a))), order[at], place


def _deal(anchor: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    bucket = ((anchor >> np.uint64(7)) % np.uint64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n + 1))


def _arranged(table: pa.Table) -> pa.Table:
    """A group's rows in an order that doesn't depend on how they came."""
    key = pa.array([hashlib.blake2b((x or "").encode(), digest_size=8).digest() for x in table.column("text").to_pylist()], pa.binary())
    return table.append_column("key", key).sort_by([("id", "ascending"), ("key", "ascending")])


def _send(width: int, n: int):
    def run(table: pa.Table) -> pa.Table:
        _, _, _, anchor, context = runs(*C.text_bytes(table.column("text")), width)
        a, c, count, _, _ = _sorted_pairs(anchor, context)
        order, edges = _deal(a, n)
        rows = [b for b in range(n) if edges[b] < edges[b + 1]]
        part = lambda x: pa.array([x[order[edges[b] : edges[b + 1]]].tobytes() for b in rows], pa.binary())
        g = table.column("g")[0].as_py()
        return pa.table({"g": pa.array([g] * len(rows), pa.int64()), "b": pa.array(rows, pa.int64()), "anchors": part(a), "contexts": part(c), "counts": part(np.minimum(count, 255).astype(np.uint8))})

    return run


def _answer(table: pa.Table) -> pa.Table:
    table = table.sort_by([("g", "ascending")])
    parts = [np.frombuffer(x, np.uint64) for x in table.column("anchors").to_pylist()]
    anchor = np.concatenate(parts)
    context = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("contexts").to_pylist()])
    count = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("counts").to_pylist()]).astype(np.int64)
    a, _, _, head, place = _sorted_pairs(anchor, context)
    total = np.bincount(place, count).astype(np.int64)
    begin = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    kinds = np.diff(np.append(begin, len(a)))
    kinds = np.repeat(kinds, kinds)
    status = np.where(total > 1, REPEATED, np.where(kinds > 1, PARTIAL, UNIQUE)).astype(np.uint8)
    out = status[place]
    # One occurrence of a repeated context stands for it where others agree with it in part.
    model = head[(total > 1) & (kinds > 1)]
    out[model] = MODEL
    salts = np.minimum(-(-kinds // SHARD_CONTEXTS), 65535).astype(np.uint16)[place]
    ends = np.cumsum([len(p) for p in parts])
    cut = lambda x: pa.array([x[e - len(p) : e].tobytes() for p, e in zip(parts, ends, strict=True)], pa.binary())
    return pa.table({"g": table.column("g"), "b": table.column("b"), "status": cut(out), "salts": cut(salts)})


SETTLED = "kind string, g bigint, doc bigint, id bigint, text string, starts binary, ends binary, shard bigint, contexts binary, sizes binary, docs binary, at binary, anchors binary, salts binary"


def _settle(width: int, n: int, n_shards: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        docs = _arranged(docs)
        data, offsets = C.text_bytes(docs.column("text"))
        own, first, last, anchor, context = runs(data, offsets, width)
        a, c, _, head, place = _sorted_pairs(anchor, context)
        order, edges = _deal(a, n)
        status, salts = np.zeros(len(a), np.uint8), np.ones(len(a), np.int64)
        for b, x, y in zip(*(answers.column(k).to_pylist() for k in ("b", "status", "salts")), strict=True):
            status[order[edges[b] : edges[b + 1]]] = np.frombuffer(x, np.uint8)
            salts[order[edges[b] : edges[b + 1]]] = np.frombuffer(y, np.uint16)
        sure = (status[place] == REPEATED) | (status[place] == MODEL)
        open_ = np.flatnonzero(status >= PARTIAL)
        sent = head[open_]
        waits = np.zeros(len(docs), bool)
        waits[own[status[place] == PARTIAL]] = True
        rows: dict[str, list] = {f.split()[0]: [] for f in SETTLED.split(", ")}

        def add(**x) -> None:
            for k, v in rows.items():
                v.append(x.get(k))

        g = docs.column("g")[0].as_py() if len(docs) else None
        cut = np.searchsorted(own[sure], np.arange(len(docs) + 1))
        s, e = first[sure], last[sure] + width
        ids, texts = docs.column("id").to_pylist(), docs.column("text").to_pylist()
        for d in range(len(docs)):
            add(kind="open" if waits[d] else "done", g=g, doc=d, id=ids[d], text=texts[d], starts=s[cut[d] : cut[d + 1]].tobytes(), ends=e[cut[d] : cut[d + 1]].tobytes())
        salt = context[sent] % salts[open_].astype(np.uint64)
        shard = (C.mix(anchor[sent] + salt * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n_shards)).astype(np.int64)
        for k in np.unique(shard):
            x = sent[shard == k]
            o = open_[shard == k]
            texts_ = [data[offsets[own[i]] + first[i] : offsets[own[i]] + last[i] + width].tobytes() for i in x]
            # A model's own document is settled: its windows only answer for others.
            doc = np.where(status[o] == MODEL, -1, own[x])
            add(kind="contexts", g=g, shard=int(k), contexts=b"".join(texts_), sizes=np.array([len(t) for t in texts_], np.int64).tobytes(), docs=doc.astype(np.int64).tobytes(), at=first[x].tobytes(), anchors=anchor[x].tobytes(), salts=salts[o].tobytes())
        types = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
        return pa.table({f.split()[0]: pa.array(rows[f.split()[0]], types[f.split()[1]]) for f in SETTLED.split(", ")})

    return run


FOUND = "g bigint, spans binary, bucket bigint, digests binary, places binary"


def _packed(key: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    """(key, bytes of each column) for each distinct key; rows keep their order."""
    order = np.argsort(key, kind="stable")
    names, at = np.unique(key[order], return_index=True)
    for name, a, b in zip(names.tolist(), at.tolist(), np.append(at[1:], len(key))[: len(at)].tolist(), strict=True):
        yield name, [np.ascontiguousarray(c[order[a:b]]).tobytes() for c in columns]


def _found(spans: np.ndarray, bucket: np.ndarray, digests: np.ndarray, places: np.ndarray) -> pa.Table:
    """Rows of FOUND: spans (g, doc, start, end) by g, and sorted digests with the places (g, doc, start) of their windows by bucket."""
    rows = [(g, x[0], None, None, None) for g, x in _packed(spans[:, 0], spans[:, 1:].astype(np.int32))]
    rows += [(None, None, b, *x) for b, x in _packed(bucket, digests, places)]
    types = (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary())
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=[f.split()[0] for f in FOUND.split(", ")])


def _shard(width: int):
    """Repeated windows of a shard's contexts, as spans of their documents. Of the contexts of an anchor that several shards have, one window of each kind goes on by a digest."""

    def run(table: pa.Table) -> pa.Table:
        # Which of several shards' anchors meet here doesn't matter: other anchors have other windows.
        blobs = {k: table.column(k).to_pylist() for k in ("g", "contexts", "sizes", "docs", "at", "anchors", "salts")}
        read = lambda k, kind: np.concatenate([np.frombuffer(x, kind) for x in blobs[k]])
        sizes, doc, at, anchor, salts = read("sizes", np.int64), read("docs", np.int64), read("at", np.int64), read("anchors", np.uint64), read("salts", np.int64)
        g = np.repeat(np.array(blobs["g"]), [len(x) // 8 for x in blobs["sizes"]])
        data = read("contexts", np.uint8)
        begin = np.cumsum(sizes) - sizes
        # A separator after each context: no window that counts has one.
        text = np.full(len(data) + len(sizes), 256, np.int16)
        place = begin + np.arange(len(sizes))
        keep = np.ones(len(text), bool)
        keep[place + sizes] = False
        text[keep] = data
        order = suffix_array(text)
        shared = common_prefixes(text, order, width, full=True)
        twice = np.zeros(len(text), bool)
        near = shared >= width
        twice[order[near]] = True
        twice[order[:-1][near[1:]]] = True
        own, nth = C.expand(sizes - width + 1)
        window = place[own] + nth
        hit = twice[window]
        # Spans of windows that follow each other.
        head = hit.copy()
        head[1:] &= ~(hit[:-1] & (own[1:] == own[:-1]))
        tail = hit.copy()
        tail[:-1] &= ~(hit[1:] & (own[1:] == own[:-1]))
        i, j = np.flatnonzero(head), np.flatnonzero(tail)
        real = doc[own[i]] >= 0
        i, j = i[real], j[real]
        spans = np.stack([g[own[i]], doc[own[i]], at[own[i]] + nth[i], at[own[i]] + nth[j] + width], 1)
        # Of windows that are equal here one goes; if it is settled, it only answers for others.
        position = np.empty(len(text), np.int64)
        position[order] = np.cumsum(~near)
        go = np.flatnonzero(salts[own] > 1)
        go = go[np.unique(position[window[go]], return_index=True)[1]]
        raw = memoryview(np.ascontiguousarray(text.astype(np.uint8)))
        digest = np.array([xxhash.xxh3_128_digest(raw[w : w + width]) for w in window[go].tolist()], DIGEST)
        by = np.argsort(digest)
        digest, go = digest[by], go[by]
        k = own[go]
        places = np.stack([g[k], np.where(hit[go], -1, doc[k]), at[k] + nth[go]], 1).astype(np.int32)
        # As many buckets as the anchor has shards: each gets about what one shard sends.
        low = np.frombuffer(digest.tobytes(), "<u8")[::2] if len(digest) else np.zeros(0, np.uint64)
        bucket = (C.mix(anchor[k] + C.mix(low % salts[k].astype(np.uint64))) >> np.uint64(1)).astype(np.int64)
        return _found(spans, bucket, digest, places)

    return run


def _merge(width: int):
    """Windows of several shards: each shard's digests, in order, are looked up by binary search among those of all."""

    def run(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, DIGEST) for x in table.column("digests").to_pylist()]
        places = [np.frombuffer(x, np.int32).reshape(-1, 3) for x in table.column("places").to_pylist()]
        every = np.sort(np.concatenate(parts), kind="stable")
        spans = []
        for part, place in zip(parts, places, strict=True):
            again = np.searchsorted(every, part, "right") - np.searchsorted(every, part, "left") > 1
            spans.append(place[again & (place[:, 1] >= 0)].astype(np.int64))
        spans = np.concatenate(spans)
        none = np.zeros(0, np.int64)
        return _found(np.concatenate([spans, spans[:, 2:] + width], 1), none, none, none).select(["g", "spans"])

    return run


RESULT = "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"


def _cut(text: np.ndarray, spans: np.ndarray) -> tuple[int, int, int, str, bytes]:
    cover = np.zeros(len(text) + 1, np.int32)
    np.add.at(cover, spans[:, 0], 1)
    np.add.at(cover, spans[:, 1], -1)
    gone = np.cumsum(cover)[:-1] > 0
    kept = text[~gone].tobytes()
    n_spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (gone[0] if len(gone) else 0))
    return len(text), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest(), kept


def _results(ids: pa.Array, out: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
    return pa.RecordBatch.from_arrays([ids, *columns], [f.split()[0] for f in RESULT.split(", ")])


def _own_spans(batch: pa.RecordBatch | pa.Table, d: int) -> np.ndarray:
    return np.stack([np.frombuffer(batch.column(k)[d].as_py(), np.int64) for k in ("starts", "ends")], 1)


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents whose spans are all known where their text was read."""
    for batch in C.pieces(batches, "text", 8 << 20):
        data, offsets = C.text_bytes(batch.column("text"))
        yield _results(batch.column("id"), [_cut(data[offsets[d] : offsets[d + 1]], _own_spans(batch, d)) for d in range(batch.num_rows)])


def _removed_later(docs: pa.Table, found: pa.Table) -> pa.Table:
    """Documents of a group that waited for spans from shards."""
    more = np.concatenate([np.zeros((0, 3), np.int32), *(np.frombuffer(x, np.int32).reshape(-1, 3) for x in found.column("spans").to_pylist())]).astype(np.int64)
    more = more[np.argsort(more[:, 0], kind="stable")]
    data, offsets = C.text_bytes(docs.column("text"))
    out = []
    for d, doc in enumerate(docs.column("doc").to_pylist()):
        a, b = np.searchsorted(more[:, 0], [doc, doc + 1])
        out.append(_cut(data[offsets[d] : offsets[d + 1]], np.concatenate([_own_spans(docs, d), more[a:b, 1:]])))
    return pa.Table.from_batches([_results(docs.column("id").combine_chunks(), out)])


def deduplicated(df: DataFrame, width: int = 200, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and kept (binary: what is left) for every row of df.

    Removed is each byte under a string of `width` bytes (more than GRAM) that starts at two places or
    more of the texts as given, one text included. Matches never reach over texts. Null and empty texts
    have no bytes; equal rows remove each other where they are long enough; ids are integers or null;
    extra columns are not read. Kept bytes need not be valid UTF-8.
    """
    if width <= GRAM:
        raise ValueError(f"width: more than {GRAM}")
    docs = df.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text"))
    total, rows = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    n_groups = max(1, -(-total // GROUP_BYTES), -(-rows // 50_000))
    n_runs = total // ((width - GRAM + 2) // 2)
    n_buckets = max(64, -(-n_runs // BUCKET_RUNS))
    n_shards = max(64, -(-total // (2 * SHARD_BYTES)))
    docs = docs.withColumn("g", F.pmod(F.xxhash64("id", F.substring("text", 1, 64)), F.lit(n_groups)))
    sent = docs.groupBy("g").applyInArrow(_send(width, n_buckets), "g bigint, b bigint, anchors binary, contexts binary, counts binary")
    answered = sent.groupBy("b").applyInArrow(_answer, "g bigint, b bigint, status binary, salts binary")
    settled = stored(docs.groupBy("g").cogroup(answered.groupBy("g")).applyInArrow(_settle(width, n_buckets, n_shards), SETTLED), "settled", compression="zstd")

    contexts = settled.where("kind = 'contexts'").select("shard", "g", "contexts", "sizes", "docs", "at", "anchors", "salts")
    found = stored(contexts.groupBy("shard").applyInArrow(_shard(width), FOUND), "found")
    merged = found.where("bucket is not null").select("bucket", "digests", "places").groupBy("bucket").applyInArrow(_merge(width), "g bigint, spans binary")
    spans = found.where("g is not null").select("g", "spans").unionByName(merged)
    rest = settled.select("kind", "g", "doc", "id", "text", "starts", "ends")
    late = rest.where("kind = 'open'").groupBy("g").cogroup(spans.groupBy("g")).applyInArrow(_removed_later, RESULT)
    return rest.where("kind = 'done'").select("id", "text", "starts", "ends").mapInArrow(_removed, RESULT).unionByName(late).withColumnRenamed("id", id_column)
