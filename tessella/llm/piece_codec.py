"""SentencePiece encoding with source offsets, and decoding.

Normalisation walks the model's compiled character map (a double-array trie) by longest prefix and
records for every normalised byte the source byte that it comes from; pieces are then projected to
byte spans of the original text. Segmentation is cut into chunks (a run of word-start marks with the
characters up to the next one, and runs of line feeds) wherever the vocabulary has no piece that
reaches over the cut, so that equal chunks are segmented once; this gives exactly the library's ids.
"""

from __future__ import annotations

import hashlib
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import columns as C

MARK = "▁"
MARK8 = MARK.encode()
#: Distinct chunks kept by a worker; beyond it the table starts anew.
TABLE_CHUNKS = 1_000_000
#: Chunks of at most so many bytes are their own keys; longer ones have SHA-256 digests.
KEY_BYTES = 64


def _fields(data: bytes):
    """(number, wire type, value) of a protocol buffer message."""

    def varint(i: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            out |= (data[i] & 127) << shift
            shift += 7
            i += 1
            if data[i - 1] < 128:
                return out, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        if key & 7 == 0:
            value, i = varint(i)
        else:
            n, i = varint(i) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], i)
            value, i = data[i : i + n], i + n
        yield key >> 3, key & 7, value


def _field(number: int, kind: int, value) -> bytes:
    def varint(n: int) -> bytes:
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    body = varint(value) if kind == 0 else (varint(len(value)) if kind == 2 else b"") + value
    return varint(number << 3 | kind) + body


class CharMap:
    """The compiled map: longest prefix of the source to its replacement."""

    def __init__(self, blob: bytes):
        self.units, self.strings = (), b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
            self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int]:
        """(replacement, source bytes used) at a position; a character without an entry stays, a stray byte becomes U+FFFD."""
        best = None
        if self.units:
            offset = lambda u: (u >> 10) << ((u & 512) >> 6)
            node = offset(self.units[0])
            for i in range(at, len(data)):
                node ^= data[i]
                if node >= len(self.units):
                    break
                unit = self.units[node]
                if unit & 0x800000FF != data[i]:
                    break
                node ^= offset(unit)
                if unit >> 8 & 1:
                    best = self.units[node] & 0x7FFFFFFF, i + 1 - at
        if best:
            start, used = best
            return self.strings[start : self.strings.index(b"\0", start)], used
        lead = data[at]
        n = 1 if lead < 0x80 else 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0
        if n:
            try:
                data[at : at + n].decode()
                return data[at : at + n], n
            except UnicodeDecodeError:
                pass
        return "�".encode(), 1


class PieceCodec:
    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            model = f.read()
        spec: dict[int, object] = {}
        self.surface, kinds, patched = [], [], b""
        for number, kind, value in _fields(model):
            if number == 1:
                one = {n: v for n, _, v in _fields(value)}
                self.surface.append(one.get(1, b""))
                kinds.append(one.get(3, 1))
            if number == 3:
                spec = {n: v for n, _, v in _fields(value)}
                value = b"".join(_field(n, k, v) for n, k, v in _fields(value) if n not in (2, 3, 4, 5)) + _field(3, 0, 0) + _field(4, 0, 0) + _field(5, 0, 0)
            patched += _field(number, kind, value)
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        #: Takes text that is normalised already.
        self.raw = sentencepiece.SentencePieceProcessor(model_proto=patched)
        self.charmap = CharMap(spec.get(2, b""))
        self.prefix, self.squeeze, self.escape = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        self.bos, self.eos = self.library.bos_id(), self.library.eos_id()
        text = [p.decode() for p, k in zip(self.surface, kinds, strict=True) if k in (1, 4)]
        #: No piece reaches over the start of a word, or holds a line feed.
        self.cuts = self.escape and all(MARK not in p.lstrip(MARK) and "\n" not in p for p in text) and self.library.id_to_piece(0) == "<unk>"
        #: The fast path: only spaces change.
        self.plain = self.cuts and not self.charmap.units and self.prefix and not self.squeeze and 4 not in kinds and 6 in kinds
        self.is_byte = np.array([k == 6 for k in kinds])
        out = [bytes([int(p[3:5], 16)]) if k == 6 else b"" if k in (2, 3) else p.replace(MARK8, b" ") for p, k in zip(self.surface, kinds, strict=True)]
        #: Bytes of text that an id stands for.
        self.length = np.array([len(x) for x in out], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(out), np.uint8)
        self.spaced = np.array([x[:1] == b" " for x in out])
        self._forget()

    def _forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.ids, self.n_ids = np.zeros(1 << 20, np.int32), 0
        self.start, self.count = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64)

    def release(self) -> None:
        """Ends a task: the table goes, and its memory."""
        self._forget()
        C.trim()

    def _learn(self, keys: list[bytes], texts: list[str]) -> None:
        found = self.raw.encode(texts, num_threads=1)
        flat = np.fromiter((i for x in found for i in x), np.int32)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        n = len(self.index)
        while n + len(keys) > len(self.start):
            self.start, self.count = np.resize(self.start, 2 * len(self.start)), np.resize(self.count, 2 * len(self.count))
        while self.n_ids + len(flat) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.n_ids : self.n_ids + len(flat)] = flat
        self.start[n : n + len(keys)] = self.n_ids + np.cumsum(counts) - counts
        self.count[n : n + len(keys)] = counts
        self.n_ids += len(flat)
        self.index.update(zip(keys, range(n, n + len(keys)), strict=True))

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """(normalised text, source offset of each of its bytes and of its end)."""
        out, origin, at, space = bytearray(), [], 0, MARK8 if self.escape else b" "
        n = len(text)
        if self.squeeze:
            while at < n:
                new, used = self.charmap.longest(text, at)
                if new.strip(b" "):
                    break
                at += used
        if at < n and self.prefix:
            out += space
            origin += [at] * len(space)
        before = self.squeeze
        while at < n:
            new, used = self.charmap.longest(text, at)
            if self.squeeze and before:
                new = new.lstrip(b" ")
            if self.squeeze and new.endswith(b" "):
                new = new.rstrip(b" ") + b" "
            before = new.endswith(b" ") if new else before
            same = new != b" " and new == text[at : at + used]
            new = new.replace(b" ", space)
            out += new
            origin += range(at, at + used) if same else [at] * len(new)
            at += used
        if self.squeeze:
            while out.endswith(space):
                del out[-len(space) :], origin[-len(space) :]
        return bytes(out), np.array([*origin, n], np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Documents to (ids, first, starts, ends): ids[first[d]:first[d+1]] are those of document d without begin and end, with byte spans in it."""
        if not self.plain or np.any((data[:-2] == MARK8[0]) & (data[1:-1] == MARK8[1]) & (data[2:] == MARK8[2])):
            return self._encode_each(data, offsets)
        size = np.diff(offsets)
        full = size > 0
        # A space before each text: the word-start mark of its first word.
        grown = size + full
        at = np.cumsum(grown) - grown
        text = np.full(int(grown.sum()), 0x20, np.uint8)
        keep = np.ones(len(text), bool)
        keep[at[full]] = False
        text[keep] = data
        space, feed = text == 0x20, text == 0x0A
        cut = np.zeros(len(text) + 1, bool)
        cut[1:-1] = (space[1:] & ~space[:-1]) | (feed[1:] != feed[:-1])
        cut[at[full]] = True
        cut[-1] = True
        edges = np.flatnonzero(cut)
        if len(edges) < 2:
            return np.zeros(0, np.int32), np.zeros(len(size) + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        starts, ends = edges[:-1], edges[1:]
        # Hashes sort the chunks; the table has them by their bytes, and what only shares a hash is a chunk of its own.
        _, where, inverse = np.unique(C.range_hash(text, starts, ends), return_index=True, return_inverse=True)
        odd = np.flatnonzero(~C.same_bytes(text, starts, ends, text, starts[where[inverse]], ends[where[inverse]]))
        inverse[odd] = len(where) + np.arange(len(odd))
        where = np.concatenate([where, odd])
        if len(self.index) + len(where) > TABLE_CHUNKS:
            self._forget()
        raw = text.tobytes()
        listed = [raw[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]
        keys = [x if len(x) <= KEY_BYTES else hashlib.sha256(x).digest() + bytes(KEY_BYTES) for x in listed]
        missing = {k: x for k, x in zip(keys, listed, strict=True) if k not in self.index}
        if missing:
            self._learn(list(missing), [x.decode(errors="replace").replace(" ", MARK) for x in missing.values()])
        row = np.fromiter(map(self.index.__getitem__, keys), np.int64, len(listed))[inverse]
        counts = self.count[row]
        owner, rank = C.expand(counts)
        ids = self.ids[self.start[row][owner] + rank]
        chunk_first = np.searchsorted(starts, np.append(at, len(text)))
        first = np.concatenate([[0], np.cumsum(counts)])[chunk_first]
        to = np.cumsum(self.length[ids])  # every byte of the padded text is in one piece
        stops = to - np.repeat(np.cumsum(full) - full + full, np.diff(first)) if len(ids) else to
        base = np.repeat(offsets[:-1], np.diff(first))
        stops = stops - base
        begins = stops - self.length[ids]
        return ids, first, np.maximum(begins, 0), stops

    def _encode_each(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        ids, spans, first = [], [], [0]
        raw = data.tobytes()
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            text, origin = self.normalise(raw[a:b])
            found = self.raw.encode(text.decode(errors="replace")) if text else []
            sizes = np.array([1 if self.is_byte[i] else len(self.surface[i]) for i in found], np.int64)
            if 0 in found:  # without byte fallback an unknown piece's length is what the library says
                sizes = np.array([len(p.encode()) for p in self.raw.encode(text.decode(errors="replace"), out_type=str)], np.int64)
            to = np.cumsum(sizes)
            ids += found
            spans.append(np.stack([origin[to - sizes], origin[to]]) if len(found) else np.zeros((2, 0), np.int64))
            first.append(len(ids))
        spans = np.concatenate(spans, axis=1) if spans else np.zeros((2, 0), np.int64)
        return np.array(ids, np.int32), np.array(first, np.int64), spans[0], spans[1]

    def decode(self, ids: np.ndarray, first: np.ndarray) -> list[bytes]:
        """The texts of documents as the library's decode gives them; begin, end and unknown ids are passed to it."""
        if not self.plain or np.any(ids == 0):
            return [self.library.decode(ids[a:b].tolist()).encode() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        lengths = self.length[ids]
        owner, rank = C.expand(lengths)
        text = self.bytes[self.begin[ids][owner] + rank].tobytes()
        ends = np.concatenate([[0], np.cumsum(lengths)])[first]
        drop = np.zeros(len(first) - 1, np.int64)
        some = np.diff(first) > 0
        drop[some] = self.spaced[ids[first[:-1][some]]]
        out = [text[a:b] for a, b in zip((ends[:-1] + drop).tolist(), ends[1:].tolist(), strict=True)]
        try:
            text.decode()
            return out
        except UnicodeDecodeError:
            return [x if _valid(x) else self.library.decode(ids[a:b].tolist()).encode() for x, a, b in zip(out, first[:-1].tolist(), first[1:].tolist(), strict=True)]


def _valid(data: bytes) -> bool:
    try:
        data.decode()
        return True
    except UnicodeDecodeError:
        return False


@lru_cache(2)
def codec(path: str) -> PieceCodec:
    """One codec for each worker process."""
    return PieceCodec(path)


def encoded(df: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text", spans: bool = True, decoded: bool = True) -> DataFrame:
    """One row per row of df: its id, `ids` (binary, little-endian unsigned 32-bit, with begin and end), `n_tokens`, `covered` (bytes of the text in spans), and if asked for `spans` (binary, little-endian int32 pairs of byte start and end for each piece between begin and end) and `decoded`.

    A null or empty text has begin and end only. Rows are kept as they are: equal rows stay apart, a
    null id stays null, other columns of df are not read. A text is encoded whole, however long.
    """
    kind = df.schema[id_column].dataType.simpleString()
    schema = "id " + kind + ", n_tokens bigint, covered bigint, ids binary" + ", spans binary" * spans + ", decoded string" * decoded

    def run(batches):
        c = codec(model_path)
        for batch in C.pieces(batches, "text"):
            data, offsets = C.text_bytes(batch.column("text"))
            ids, first, starts, ends = c.encode(data, offsets)
            edges = list(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
            out = [batch.column("id"), pa.array(np.diff(first) + 2), pa.array([int(ends[b - 1]) if b > a else 0 for a, b in edges], pa.int64())]
            bos, eos, body = np.uint32(c.bos).tobytes(), np.uint32(c.eos).tobytes(), ids.astype("<u4").tobytes()
            out.append(pa.array([bos + body[4 * a : 4 * b] + eos for a, b in edges], pa.binary()))
            if spans:
                pairs = np.stack([starts, ends], 1).astype("<i4").tobytes()
                out.append(pa.array([pairs[8 * a : 8 * b] for a, b in edges], pa.binary()))
            if decoded:
                out.append(pa.array(c.decode(ids, first), pa.binary()).cast(pa.string()))
            names = ["id", "n_tokens", "covered", "ids"] + ["spans"] * spans + ["decoded"] * decoded
            yield pa.RecordBatch.from_arrays(out, names)
        c.release()

    got = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(run, schema)
    return got.withColumnRenamed("id", id_column)
