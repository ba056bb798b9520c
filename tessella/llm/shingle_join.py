"""Exact n-gram Jaccard join: size-banded tiles with hashed bitmap signatures.

1. Documents are dealt into groups by a hash of their id. Each group sends the distinct shingle hashes of
   its documents, packed and with local counts, to buckets by hash; the buckets answer with a frequency
   class for each. A document can only have a partner if 75 % of its shingles occur in another one.
2. Those that remain put their shingles in order of class and hash, and keep the prefix that any two sets
   of the required overlap must share. Shared prefix entries give candidate clusters.
3. A cluster of one tile is compared in one task. Bit counts of hashed bitmaps bound the overlap from above;
   what passes is intersected exactly as sorted arrays. Pairs that are connected already are not compared:
   links are wanted as connected classes.
4. A larger cluster is cut into tiles by band of size, so that only equal and neighbouring bands meet, and by
   a hash of the node within a band. Pairs of tiles get the bitmaps, a small part of the sets. Each proposes
   the best pairs that span what may be connected, and only those have their sets shipped and intersected:
   first inside tiles, then between what is still apart. Where a proposal fails, the pairs it stood for are
   open: all sets with a pair that the bitmaps leave open meet once more, whole. No pair goes unseen.

A node stands for all documents with the same shingle set. Shingles and nodes are 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import columns as C
from tessella.llm.components import components
from tessella.llm.scratch import stored

#: Text of a group of documents, distinct shingles of a bucket, and nodes and shingles of a tile: what one task holds.
GROUP_BYTES = 2 << 20
BUCKET_SHINGLES = 2 << 20
TILE_NODES = 4096
TILE_SHINGLES = 4 << 20
#: Documents that hold a shingle, at least, for each class after the first.
CLASSES = np.array([2, 32, 1024])


def shingles(column: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the distinct shingles of each text, ascending. Fewer words than the width are one shingle; none, none."""
    data, offsets = C.text_bytes(column)
    low = C.LOWER[data]
    starts, ends, first = C.tokens(low, offsets, C.NOT_SPACE6)
    words = C.range_hash(low, starts, ends)
    counts = np.diff(first)
    n = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    own, nth = C.expand(n)
    at = first[own] + nth
    hashes = C.window_hash(words, at, np.minimum(counts[own], width))
    order = np.argsort(hashes)
    own, hashes = own[order], hashes[order]
    order = np.argsort(own.astype(np.int32), kind="stable")
    own, hashes = own[order], hashes[order]
    fresh = np.ones(len(own), bool)
    fresh[1:] = (own[1:] != own[:-1]) | (hashes[1:] != hashes[:-1])
    own, hashes = own[fresh], hashes[fresh]
    return hashes, np.searchsorted(own, np.arange(len(n) + 1))


def nodes(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each set, not negative."""
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(C.mix(hashes ^ np.uint64(0xA5A5A5A5DEADBEEF)), out=sums[1:])
    h = C.mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (h >> np.uint64(1)).astype(np.int64)


def _deal(distinct: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, edges, short): hashes by bucket and then by their upper half, the same wherever they come from."""
    bucket = ((distinct & np.uint64(0xFFFFFFFF)) % np.uint64(n)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")  # distinct ascends, and so do the upper halves
    return order, np.searchsorted(bucket[order], np.arange(n + 1)), (distinct[order] >> np.uint64(32)).astype(np.uint32)


def _send(n: int):
    def run(table: pa.Table) -> pa.Table:
        hashes, _ = shingles(table.column("text"))
        distinct, counts = np.unique(hashes, return_counts=True)
        order, edges, short = _deal(distinct, n)
        counts = np.minimum(counts[order], 65535).astype(np.uint16)
        rows = [b for b in range(n) if edges[b] < edges[b + 1]]
        g = table.column("g")[0].as_py()
        some = [np.flatnonzero(counts[edges[b] : edges[b + 1]] > 1) for b in rows]
        return pa.table(
            {
                "g": pa.array([g] * len(rows), pa.int64()),
                "b": pa.array(rows, pa.int64()),
                "keys": pa.array([short[edges[b] : edges[b + 1]].tobytes() for b in rows], pa.binary()),
                "at": pa.array([x.astype(np.int32).tobytes() for x in some], pa.binary()),
                "more": pa.array([counts[edges[b] : edges[b + 1]][x].tobytes() for b, x in zip(rows, some, strict=True)], pa.binary()),
            }
        )

    return run


def _answer(table: pa.Table) -> pa.Table:
    parts = [np.frombuffer(x, np.uint32) for x in table.column("keys").to_pylist()]
    keys = np.concatenate(parts)
    weight = np.ones(len(keys), np.int64)
    base = 0
    for part, at, more in zip(parts, table.column("at").to_pylist(), table.column("more").to_pylist(), strict=True):
        weight[base + np.frombuffer(at, np.int32)] = np.frombuffer(more, np.uint16)
        base += len(part)
    order = np.argsort(keys, kind="stable")
    head = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
    sums = np.add.reduceat(weight[order], head)
    kind = np.empty(len(keys), np.uint8)
    kind[order] = np.repeat(np.searchsorted(CLASSES, sums, "right").astype(np.uint8), np.diff(np.append(head, len(keys))))
    ends = np.cumsum([len(p) for p in parts])
    return pa.table({"g": table.column("g"), "b": table.column("b"), "kind": pa.array([kind[e - len(p) : e].tobytes() for p, e in zip(parts, ends, strict=True)], pa.binary())})


def sketch(own: np.ndarray) -> np.ndarray:
    """A bitmap of a set's hashes, of four to eight bits for each, a power of two in all. Halves laid over each other are the bitmap of half the width."""
    width = max(128, 2 << (2 * len(own) - 1).bit_length())
    place = (own >> np.uint64(7)) & np.uint64(width - 1)
    flags = np.zeros(width, bool)
    flags[place.astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").view(np.uint64)


SIFTED = "id bigint, g bigint, node bigint, n bigint, hashes binary, prefix binary, bits binary"


def _sift(n_buckets: int, share: int):
    """share: percent of the union that two sets must have in common."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        hashes, first = shingles(docs.column("text"))
        size = np.diff(first)
        node = nodes(hashes, first)
        distinct, inverse = np.unique(hashes, return_inverse=True)
        order, edges, _ = _deal(distinct, n_buckets)
        kind = np.zeros(len(distinct), np.uint8)
        for b, blob in zip(answers.column("b").to_pylist(), answers.column("kind").to_pylist(), strict=True):
            kind[order[edges[b] : edges[b + 1]]] = np.frombuffer(blob, np.uint8)
        kind = kind[inverse]
        shared = C.per_owner(first, kind > 0)
        holder = np.zeros(len(size), bool)
        holder[np.unique(node, return_index=True)[1]] = True
        holder &= (size > 0) & (100 * shared >= share * size)
        length = size - -(-share * size // 100) + 1
        sets, prefixes, bits = [], [], []
        for d in range(len(size)):
            if not holder[d]:
                sets.append(None)
                prefixes.append(None)
                bits.append(None)
                continue
            own, of = hashes[first[d] : first[d + 1]], kind[first[d] : first[d + 1]]
            sets.append(own.tobytes())
            by = np.argsort(of, kind="stable")[: length[d]]
            prefixes.append(own[by[of[by] > 0]].tobytes())
            bits.append(sketch(own).tobytes())
        return pa.table(
            {
                "id": docs.column("id"),
                "g": docs.column("g"),
                "node": pa.array(node, mask=size == 0),
                "n": pa.array(size.astype(np.int64)),
                "hashes": pa.array(sets, pa.binary()),
                "prefix": pa.array(prefixes, pa.binary()),
                "bits": pa.array(bits, pa.binary()),
            }
        )

    return run


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the nodes of edges u-v that aren't the smallest."""
    names, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(names))
    return names[moved], names[label[moved]]


def _pack(n: int):
    """Prefix entries by bucket: one row for each bucket and batch, with each entry once, and the nodes that share one inside the batch as edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.pieces(batches, "prefix", 8 << 20):
            data, offsets = C.text_bytes(batch.column("prefix"))
            keys = np.frombuffer(data.tobytes(), np.uint64)
            node = np.repeat(np.asarray(batch.column("node"), np.int64), np.diff(offsets) // 8)
            order = np.lexsort((node, keys))
            keys, node = keys[order], node[order]
            lead = np.ones(len(keys), bool)
            lead[1:] = keys[1:] != keys[:-1]
            leader = node[lead][np.cumsum(lead) - 1] if len(keys) else node
            u, v = forest(leader[~lead], node[~lead]) if not lead.all() else (node[:0], node[:0])
            keys, node = keys[lead], node[lead]
            bucket = ((keys >> np.uint64(17)) % np.uint64(n)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, keys, node = bucket[order], keys[order], node[order]
            rows, at = np.unique(bucket, return_index=True)
            ends = np.append(at[1:], len(bucket))
            out = [(int(b), keys[i:j].tobytes(), node[i:j].tobytes(), b"", b"") for b, i, j in zip(rows, at, ends, strict=True)]
            if len(u):
                out.append((int(u[0] % n), b"", b"", u.tobytes(), v.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), *(pa.array([r[k] for r in out], pa.binary()) for k in range(1, 5))], ["b", "keys", "nodes", "u", "v"])

    return run


def _meet(table: pa.Table) -> pa.Table:
    read = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in table.column(name).to_pylist()])
    keys, node, u, v = read("keys", np.uint64), read("nodes", np.int64), read("u", np.int64), read("v", np.int64)
    order = np.lexsort((node, keys))
    keys, node = keys[order], node[order]
    lead = np.ones(len(keys), bool)
    lead[1:] = keys[1:] != keys[:-1]
    leader = node[lead][np.cumsum(lead) - 1] if len(keys) else node
    a, b = forest(np.concatenate([u, leader[~lead]]), np.concatenate([v, node[~lead]]))
    return pa.table({"u": a, "v": b})


class Sketches:
    """Bitmaps of the sets of one task, and the pairs among them that are worth an exact look."""

    def __init__(self, node: np.ndarray, size: np.ndarray, bits: list[np.ndarray], side: np.ndarray, label: np.ndarray, share: int):
        """label: the class that each node is known to be in."""
        self.order = order = np.lexsort((node, size))
        self.node, self.size, self.side, self.share = node[order], size[order], side[order], share
        self.root = np.unique(label[order], return_inverse=True)[1]
        bits = [bits[i] for i in order]
        # Sizes ascend, and so do widths: a block for each.
        self.width = np.array([len(x) for x in bits])
        self.first = {int(w): int(np.searchsorted(self.width, w)) for w in np.unique(self.width)}
        self.block = {w: np.stack(bits[lo : int(np.searchsorted(self.width, w, "right"))]) for w, lo in self.first.items()}
        self.ones = np.array([int(np.bitwise_count(x).sum(dtype=np.int64)) for x in bits])

    def _most(self, i: int, others: np.ndarray) -> np.ndarray:
        """Upper bounds of the intersections of set i with others, ascending and none larger: what is set in one bitmap only is in one set only."""
        most = np.zeros(len(others), np.int64)
        mine = self.block[int(self.width[i])][i - self.first[int(self.width[i])]]
        while True:
            lo, hi = np.searchsorted(self.width[others], [len(mine), len(mine) + 1])
            if lo < hi:
                j = others[lo:hi]
                both = np.bitwise_count(self.block[len(mine)][j - self.first[len(mine)]] & mine).sum(1, dtype=np.int64)
                ones = int(np.bitwise_count(mine).sum(dtype=np.int64))
                most[lo:hi] = np.minimum(self.size[i] - ones + both, self.size[j] - self.ones[j] + both)
            if not lo:
                return most
            mine = mine[: len(mine) // 2] | mine[len(mine) // 2 :]

    def near(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(others, bounds): smaller sets of other classes that set i may link with. Sets of the same side are compared only where side is 2."""
        j = np.arange(int(np.searchsorted(self.size, -(-self.share * self.size[i] // 100))), i)
        if self.side[i] != 2:
            j = j[self.side[j] != self.side[i]]
        j = j[self.root[j] != self.root[i]]
        if not len(j):
            return j, j
        most = self._most(i, j)
        may = 100 * most >= self.share * (self.size[i] + self.size[j] - most)
        return j[may], most[may]

    def proposals(self) -> list[tuple[int, int]]:
        """Pairs of places in the given order: the likeliest of a set and each class it may link with, which count as one class from there on."""
        out = []
        for i in range(1, len(self.node)):
            j, most = self.near(i)
            if len(j):
                j = j[np.argsort(-most / (self.size[i] + self.size[j] - most), kind="stable")]
                kinds, at = np.unique(self.root[j], return_index=True)
                out += [(int(self.order[i]), int(self.order[k])) for k in j[at]]
                self.root[np.isin(self.root, kinds)] = self.root[i]
        return out

    def undecided(self) -> np.ndarray:
        """Places of the sets that may link with one of another class."""
        found = np.zeros(len(self.node), bool)
        for i in range(1, len(self.node)):
            j, _ = self.near(i)
            found[j] = True
            found[i] |= len(j) > 0
        return self.order[found]


class Tile(Sketches):
    """Sets of one task and the classes found among them."""

    def __init__(self, node: np.ndarray, sets: list[np.ndarray], side: np.ndarray, label: np.ndarray, share: int):
        super().__init__(node, np.array([len(s) for s in sets]), [sketch(s) for s in sets], side, label, share)
        self.sets = [sets[i] for i in self.order]
        self.flat = np.concatenate(self.sets)
        self.begin = np.cumsum(self.size) - self.size

    def _common(self, i: int, others: np.ndarray) -> np.ndarray:
        """Exact sizes of the intersections of set i with others."""
        out = np.zeros(len(others), np.int64)
        mine = self.sets[i]
        for lo in range(0, len(others), 512):
            part = others[lo : lo + 512]
            own, nth = C.expand(self.size[part])
            values = self.flat[self.begin[part][own] + nth]
            hit = mine[np.minimum(np.searchsorted(mine, values), len(mine) - 1)] == values
            out[lo : lo + len(part)] = np.bincount(own, hit, len(part)).astype(np.int64)
        return out

    def _linked(self, i: int, others: np.ndarray) -> np.ndarray:
        common = self._common(i, others)
        return others[100 * common >= self.share * (self.size[i] + self.size[others] - common)]

    def links(self) -> list[tuple[int, int]]:
        """Edges that span every class."""
        out = []
        for i in range(1, len(self.node)):
            j, _ = self.near(i)
            # One of each class first: near copies of one text are mostly linked with each other.
            while len(j):
                ask = j[np.unique(self.root[j][::-1], return_index=True)[1] * -1 + len(j) - 1]
                rest = np.setdiff1d(j, ask, assume_unique=True)
                for k in self._linked(i, ask):
                    if self.root[k] != self.root[i]:
                        out.append((int(self.node[i]), int(self.node[k])))
                        self.root[self.root == self.root[k]] = self.root[i]
                j = rest[self.root[rest] != self.root[i]]
        return out


def _runs(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[list[tuple]]:
    """Rows of the columns, those that follow each other with the same first value together."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            if held and held[0][0] != row[0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _sketches(held: list[tuple], share: int) -> Sketches:
    _, node, side, _, n, label, bits = zip(*held, strict=True)
    return Sketches(np.array(node), np.array(n), [np.frombuffer(x, np.uint64) for x in bits], np.array(side), np.array(label), share)


SKETCHED = ("task", "node", "side", "g", "n", "label", "bits")


def _propose(share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _runs(batches, SKETCHED):
            rows = [(held[a][0], held[a][1], held[a][3], held[b][1], held[b][3]) for a, b in _sketches(held, share).proposals()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], ["task", "u", "ug", "v", "vg"])
        C.trim()

    return run


def _undecided(share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _runs(batches, SKETCHED):
            rows = [held[k] for k in _sketches(held, share).undecided()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1, 2, 3, 5)], ["task", "node", "side", "g", "label"])
        C.trim()

    return run


def _verify(share: int):
    """Whether the pairs (u, v) link, by their sets; a row without v brings that of u, before the others of u."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = mine = None
        for batch in batches:
            rows = []
            for u, v, task, blob in zip(*(batch.column(c).to_pylist() for c in ("u", "v", "task", "hashes")), strict=True):
                own = np.frombuffer(blob, np.uint64)
                if v is None:
                    node, mine = u, own
                    continue
                if node != u:
                    raise RuntimeError("a pair came without its first set")
                common = int((mine[np.minimum(np.searchsorted(mine, own), len(mine) - 1)] == own).sum())
                rows.append((task, u, v, 100 * common >= share * (len(mine) + len(own) - common)))
            yield pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in rows], pa.int64()) for k in range(3)), pa.array([r[3] for r in rows], pa.bool_())], ["task", "u", "v", "linked"])
        C.trim()

    return run


def _compare(share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _runs(batches, ("task", "node", "side", "label", "hashes")):
            _, node, side, label, blobs = zip(*held, strict=True)
            links = Tile(np.array(node), [np.frombuffer(x, np.uint64) for x in blobs], np.array(side), np.array(label), share).links()
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in range(2)], ["u", "v"])
        C.trim()

    return run


def _tiled(holders: DataFrame, share: int) -> DataFrame:
    """Nodes of large clusters (node, g, n, component) with the tasks they take part in, as an array of (task, side). Sides 0 and 1 meet each other, those of 2 all others."""
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / share) + F.lit(1e-9))
    holders = holders.withColumn("band", band)
    tiles = F.greatest(F.ceil(F.count("*") / TILE_NODES), F.ceil(F.sum("n") / TILE_SHINGLES))
    bands = holders.groupBy("component", "band").agg(tiles.alias("m"))
    for name, step in (("m", 0), ("up", -1), ("down", 1)):
        holders = holders.join(bands.select("component", (F.col("band") + step).alias("band"), F.col("m").alias(name)), ["component", "band"], "left")
    salt = F.pmod(F.xxhash64("node"), F.col("m"))
    every = lambda m, f: F.when(F.col(m).isNull(), F.array()).otherwise(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col(m) - 1), f))
    key = lambda kind, b, x, y: F.xxhash64(F.col("component"), F.lit(kind), b, x, y)
    row = lambda task, side: F.struct(task.alias("task"), side.alias("side"))
    same = every("m", lambda k: row(key("same", F.col("band"), F.least(salt, k), F.greatest(salt, k)), F.when(salt == k, 2).when(salt < k, 0).otherwise(1)))
    above = every("up", lambda k: row(key("next", F.col("band"), salt, k), F.lit(0)))
    below = every("down", lambda k: row(key("next", F.col("band") - 1, k, salt), F.lit(1)))
    return holders.select("node", "g", "n", F.concat(same, above, below).alias("tasks"))


def _large(held: DataFrame, holders: DataFrame, share: int) -> DataFrame:
    """(u, v): links that span the classes of clusters of several tiles."""
    n_tasks = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = lambda df, *by: df.repartition(n_tasks, by[0]).sortWithinPartitions(*by)
    nodes = stored(_tiled(holders, share).join(held.select("node", "g", "bits"), ["node", "g"]), "sketches")
    sets = held.select("node", "g", "hashes")

    def rows(labels: DataFrame | None) -> DataFrame:
        """A row for each node and task."""
        own = nodes.select("node", "g", "n", "bits", F.explode("tasks").alias("t")).select("node", "g", "n", "bits", "t.task", "t.side")
        if labels is None:
            return own.withColumn("label", F.col("node"))
        return own.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")

    def proposed(own: DataFrame) -> DataFrame:
        """(task, u, v, linked) of the pairs that tasks propose."""
        pairs = stored(spread(own, "task").mapInArrow(_propose(share), "task bigint, u bigint, ug bigint, v bigint, vg bigint"), "proposed")
        of = lambda side, *more: pairs.select(F.col(side).alias("node"), F.col(f"{side}g").alias("g"), *more)
        mine = of("u").distinct().join(sets, ["node", "g"]).select(F.col("node").alias("u"), F.lit(None).cast("bigint").alias("v"), F.lit(None).cast("bigint").alias("task"), "hashes")
        others = of("v", "u", "task").join(sets, ["node", "g"]).select("u", F.col("node").alias("v"), "task", "hashes")
        both = spread(mine.unionByName(others), "u", F.col("v").asc_nulls_first())
        return stored(both.mapInArrow(_verify(share), "task bigint, u bigint, v bigint, linked boolean"), "judged")

    # Where all proposals hold, the pairs they stood for are connected.
    failed = lambda judged: judged.where("not linked").select("task").distinct()
    inside = proposed(rows(None).where("side = 2"))
    links = inside.where("linked").select("u", "v")
    labels = stored(components(links), "labels")
    own = rows(labels)
    between = proposed(own.where("side <> 2").unionByName(own.join(failed(inside), "task", "left_semi")))
    links = links.unionByName(between.where("linked").select("u", "v"))
    opened = failed(between)
    if opened.isEmpty():
        return links
    labels = stored(components(links), "labels")
    left = stored(spread(rows(labels).join(opened, "task", "left_semi"), "task").mapInArrow(_undecided(share), "task bigint, node bigint, side bigint, g bigint, label bigint"), "undecided")
    left = left.join(sets, ["node", "g"]).select("task", "node", "side", "label", "hashes")
    return links.unionByName(spread(left, "task").mapInArrow(_compare(share), "u bigint, v bigint"))


def classes(df: DataFrame, share: int = 75, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_shingles, component_id (smallest id reachable by links, its own included) for every row of df.

    Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z, shingles are five words; two texts link when
    100 * intersection >= share * union (share from 50). Null, empty and blank texts have no shingles and
    link with nothing, equal rows each get a row, a null id is passed over when the smallest is taken. Ids
    are integers; extra columns are not read. Every link counts, whatever the size of a class.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text"))
    total, rows = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    n_groups = max(1, -(-total // GROUP_BYTES), -(-rows // 50_000))
    n_buckets = max(64, -(-total // 6 // BUCKET_SHINGLES))
    # Equal rows and null ids are dealt by the text, as far as they share an id only.
    docs = docs.withColumn("g", F.pmod(F.xxhash64("id", F.substring("text", 1, 64)), F.lit(n_groups)))
    sent = docs.groupBy("g").applyInArrow(_send(n_buckets), "g bigint, b bigint, keys binary, at binary, more binary")
    answered = sent.groupBy("b").applyInArrow(_answer, "g bigint, b bigint, kind binary")
    sifted = stored(docs.groupBy("g").cogroup(answered.groupBy("g")).applyInArrow(_sift(n_buckets, share), SIFTED), "sifted")

    held = sifted.where("hashes is not null")
    prefix_bytes = held.agg(F.coalesce(F.sum(F.octet_length("prefix")), F.lit(0))).first()[0]
    n_meet = max(64, -(-prefix_bytes // 8 // BUCKET_SHINGLES))
    edges = held.select("node", "prefix").mapInArrow(_pack(n_meet), "b bigint, keys binary, nodes binary, u binary, v binary").groupBy("b").applyInArrow(_meet, "u bigint, v bigint")
    clusters = components(edges)

    # One holder for each node of a cluster.
    holders = held.groupBy("node").agg(F.min("g").alias("g"), F.min("n").alias("n")).join(clusters, "node")
    sizes = holders.groupBy("component").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    whole = (F.col("c") <= TILE_NODES) & (F.col("s") <= TILE_SHINGLES)
    holders = stored(holders.join(sizes.where("c > 1").select("component", whole.alias("whole")), "component"), "holders")
    work = holders.where("whole").select("node", "g", F.xxhash64("component").alias("task"), F.lit(2).alias("side"), F.col("node").alias("label"))
    work = work.join(held.select("node", "g", "hashes"), ["node", "g"]).select("task", "node", "side", "label", "hashes")
    n_tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    links = work.repartition(n_tasks, "task").sortWithinPartitions("task").mapInArrow(_compare(share), "u bigint, v bigint")
    large = holders.where("not whole").select("node", "g", "n", "component")
    linked = components(links if large.isEmpty() else links.unionByName(_large(held, large, share)))

    lowest = sifted.groupBy("node").agg(F.min("id").alias("low")).where("node is not null")
    lowest = lowest.join(linked, "node", "left").select("node", "low", F.coalesce("component", "node").alias("component"))
    named = lowest.join(lowest.groupBy("component").agg(F.min("low").alias("component_id")), "component").select("node", "component_id")
    out = sifted.select("id", "node", F.col("n").alias("n_shingles")).join(named, "node", "left")
    return out.select(F.col("id").alias(id_column), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
