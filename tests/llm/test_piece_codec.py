import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tessella.llm import columns as C
from tessella.llm.piece_codec import CharMap, codec, encoded

PATH = P.path("piece_bpe_32k.model")
TEXTS = ["", "a", " ", "   a", "a  b\n\n c ", "\n", "\nx", "x\n", "é ü z", "a▁b", "\x00a\x01", "<s>x</s> <unk> <0x0A>", "𝒳 y𝒳", "tab\tx \t y", "日本語 テキスト", "word " * 500, "x" * 3000, "a\r\nb", "�", " \n \n", "é"]


def arrays(texts):
    return C.text_bytes(pa.array(texts, pa.string()))


@pytest.mark.parametrize("texts", [TEXTS, [t for t in TEXTS if "▁" not in t]])
def test_ids_and_text_are_the_librarys(texts):
    c = codec(PATH)
    data, offsets = arrays(texts)
    ids, first, starts, ends = c.encode(data, offsets)
    got = [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])]
    assert got == c.library.encode(texts)
    assert [x.decode() for x in c.decode(ids, first)] == [c.library.decode(x) for x in got]


@pytest.mark.parametrize("texts", [TEXTS, [t for t in TEXTS if "▁" not in t]])
def test_spans_tile_the_source(texts):
    c = codec(PATH)
    data, offsets = arrays(texts)
    ids, first, starts, ends = c.encode(data, offsets)
    for t, a, b in zip(texts, first[:-1], first[1:]):
        raw, at = t.encode(), 0
        for i, s, e in zip(ids[a:b], starts[a:b], ends[a:b]):
            assert s == at and e >= s
            at = e
            own = bytes(c.bytes[c.begin[i] : c.begin[i] + c.length[i]])
            assert raw[s:e].replace("▁".encode(), b" ") in (own, own[1:] if s == 0 else own)
        assert at == len(raw)


def test_slow_path_agrees():
    c = codec(PATH)
    texts = [t for t in TEXTS if "▁" not in t]
    data, offsets = arrays(texts)
    for x, y in zip(c.encode(data, offsets), c._encode_each(data, offsets)):
        assert np.array_equal(x, y)


def darts(entries):
    """A double array of byte strings to values, laid out naively: enough to test the walk."""
    size = 1 << 16
    units = [0] * size
    used, origins = {0}, set()

    def place(node, keys, depth):
        kids = sorted({k[depth] if depth < len(k) else 0 for k in keys})
        base = 1
        while node ^ base in origins or any((node ^ base ^ k) in used or node ^ base ^ k >= size for k in kids):
            base += 1
        assert base < 1 << 21
        origins.add(node ^ base)
        units[node] |= base << 10
        for k in kids:
            used.add(node ^ base ^ k)
        for k in kids:
            child = node ^ base ^ k
            if k == 0:
                units[node] |= 1 << 8
                units[child] = entries[next(x for x in keys if len(x) == depth)] | 1 << 31
            else:
                units[child] |= k
                place(child, [x for x in keys if depth < len(x) and x[depth] == k], depth + 1)

    place(0, sorted(entries), 0)
    return np.array(units, "<u4").tobytes()


def test_character_map_takes_the_longest_prefix():
    strings, entries = b"", {}
    for source, target in {"a": "1", "ab": "2", "é": "e", " ": " ", "ff": ""}.items():
        entries[source.encode()] = len(strings)
        strings += target.encode() + b"\0"
    trie = darts(entries)
    m = CharMap(len(trie).to_bytes(4, "little") + trie + strings)
    at, out = 0, []
    text = "abaéb fff".encode()
    while at < len(text):
        new, n = m.longest(text, at)
        out.append((new.decode(), n))
        at += n
    assert out == [("2", 2), ("1", 1), ("e", 2), ("b", 1), (" ", 1), ("", 2), ("f", 1)]
    assert CharMap(b"").longest(b"\xff", 0) == ("�".encode(), 1)


def test_rows(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, None, "y"), (3, "", None)], "doc_id bigint, text string, ids string")
    rows = sorted(encoded(df, PATH).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert [r.doc_id for r in rows] == [1, 1, 3, None]
    assert [r.n_tokens for r in rows] == [4, 4, 2, 2] and rows[0].decoded == "a b" and rows[0].covered == 3
    assert np.frombuffer(rows[0].spans, "<i4").tolist() == [0, 1, 1, 3]
    assert encoded(df.limit(0), PATH).count() == 0
