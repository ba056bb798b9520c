"""Hashes of byte strings: equal strings only have equal ones, also where they are built to cancel out."""

import numpy as np
import public_tokenizers
from tessella.llm import columns as C
from tessella.llm import decontaminate, quality, shingle_join
from tessella.llm.piece_codec import codec

PATH = public_tokenizers.path("piece_bpe_32k.model")


def doubling(n, a="a", b="b"):
    """(s, s with its letters exchanged), where s doubles by its own complement: sums with powers of any base meet modulo 2^64."""
    s, t = a, b
    while len(s) < n:
        s, t = s + t, t + s
    return s, t


PAIRS = [doubling(n) for n in (1, 8, 64, 1024, 4096)] + [doubling(1024, "abcdefgh", "ijklmnop"), ("x" + "y" * 50, "x" + "y" * 51), ("", "\0")]


def split(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def test_strings_and_windows():
    texts = [t for p in PAIRS for t in p]
    data, offsets = split(["#", *texts, *texts, "#"])
    h = C.range_hash(data, offsets[1:-2], offsets[2:-1])
    n = len(texts)
    assert np.array_equal(h[:n], h[n:]) and len(set(h[:n].tolist())) == len(set(texts))
    s, t = (np.frombuffer(x.encode(), np.uint8).astype(np.uint64) for x in doubling(64))
    both = C.window_hash(np.concatenate([s, t, s]), np.array([0, 64, 128, 0]), np.array([64, 64, 64, 63]))
    assert both[0] == both[2] and len(set(both.tolist())) == 3


def test_same_bytes():
    r = np.random.default_rng(0)
    strings = [bytes(r.integers(0, 2, int(r.integers(0, 70)), np.uint8)) for _ in range(60)] + [b"a" * 300, b"a" * 299 + b"b", b"a" * 300]
    data, ends = np.frombuffer(b"".join(strings), np.uint8), np.cumsum([len(x) for x in strings])
    starts = ends - [len(x) for x in strings]
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(strings)), np.arange(len(strings))))
    assert C.same_bytes(data, starts[i], ends[i], data, starts[j], ends[j]).tolist() == [strings[a] == strings[b] for a, b in zip(i, j)]


def test_words_lines_and_shingles():
    s, t = doubling(1024)
    data, offsets = split([s, t])
    terms, _ = decontaminate.words(data, offsets)
    assert terms[0] != terms[1]
    import pyarrow as pa

    found, first = shingle_join.shingles(pa.array([f"{s} b c d e", f"{t} b c d e", s, t]))
    assert len(set(found.tolist())) == 4 and len(set(shingle_join.nodes(found, first).tolist())) == 4
    out = quality._measure(*split([f"{s}\n{t}\n{s}", f"{s} b c {t} b c {s} b c"]), PATH)
    assert out[3].tolist() == [1, 0] and out[4].tolist() == [0, 6 + 0]


def test_pieces():
    s, t = doubling(1024)
    texts = [f"{s} x", f"{t} x", f"{t} {s}"]
    c = codec(PATH)
    ids, first, _, _ = c.encode(*split(texts))
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [c.library.encode(x)[0 if c.library.encode(x)[0] != c.bos else 1 :] for x in texts]
