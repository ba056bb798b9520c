import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessella.llm import repeated_bytes as R
from tessella.llm.suffix_array import common_prefixes, suffix_array


def test_suffix_array_and_prefixes():
    r = np.random.default_rng(0)
    for n, k in [(1, 2), (2, 2), (50, 2), (300, 3), (2000, 2), (500, 1), (900, -3)]:
        x = r.integers(0, abs(k), n) * (1 if k > 0 else 1000)
        order = suffix_array(x)
        want = sorted(range(n), key=lambda i: x[i:].tolist())
        assert order.tolist() == want
        for cap in (5, 10_000):
            got = common_prefixes(x, order, cap, 16)
            for i in range(1, n, max(1, n // 50)):
                a, b = x[order[i - 1] :], x[order[i] :]
                m = min(len(a), len(b))
                diff = np.flatnonzero(a[:m] != b[:m])
                assert got[i] == min(cap, diff[0] if len(diff) else m)


def test_prefixes_of_an_order_by_depth():
    r = np.random.default_rng(6)
    for k in range(60):
        x = r.integers(0, 26, 1500)
        a, b, n = (int(v) for v in (r.integers(0, 500), r.integers(700, 1100), r.integers(30, 400)))
        x[b : b + n] = x[a : a + n]
        cap = int(r.integers(20, 220))
        order = suffix_array(x, cap) if k % 2 else suffix_array(x)
        got = common_prefixes(x, order, cap, 64, full=not k % 2)
        same = lambda p, q: next((i for i in range(cap) if max(p, q) + i >= len(x) or x[p + i] != x[q + i]), cap)
        assert got.tolist() == [0] + [same(p, q) for p, q in zip(order[:-1].tolist(), order[1:].tolist())]


def brute(rows, width):
    seen = {}
    texts = [(t or "").encode() for _, t in rows]
    for d, t in enumerate(texts):
        for i in range(len(t) - width + 1):
            seen.setdefault(t[i : i + width], []).append((d, i))
    gone = [np.zeros(len(t), bool) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i : i + width] = True
    out = []
    for (doc, _), t, x in zip(rows, texts, gone):
        n = sum(1 for i in range(len(x)) if x[i] and (i == 0 or not x[i - 1]))
        out.append((doc, len(t), int(x.sum()), n, hashlib.sha256(bytes(b for b, y in zip(t, x) if not y)).hexdigest()))
    return out


def corpus(seed, alphabet="abcdé ", n=60):
    r = np.random.default_rng(seed)
    text = lambda k: "".join(r.choice(list(alphabet), k))
    shared = [text(int(r.integers(40, 500))) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = [text(int(r.integers(0, 300)))]
        for _ in range(int(r.integers(0, 3))):
            s = shared[int(r.integers(4))]
            a = int(r.integers(0, len(s) // 2))
            parts += [s[a : a + int(r.integers(20, 400))], text(int(r.integers(0, 90)))]
        rows.append((i, "".join(parts)))
    return rows + [(100, rows[3][1]), (101, rows[3][1]), (101, rows[3][1]), (102, None), (103, ""), (104, "a" * 500), (105, text(50)), (None, shared[0] * 3), (None, None)]


@pytest.mark.parametrize("seed, width, group, contexts, stretch", [(1, 200, 2 << 20, 4096, 1 << 22), (2, 60, 3000, 2, 1 << 22), (3, 100, 2000, 1, 700)])
def test_against_brute_force(spark, monkeypatch, seed, width, group, contexts, stretch):
    for k, v in {"GROUP_BYTES": group, "SHARD_CONTEXTS": contexts, "STRETCH": stretch}.items():
        monkeypatch.setattr(R, k, v)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("g", F.lit("x")).repartition(3)
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    got = [tuple(x)[:5] for x in R.deduplicated(df, width).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, width), key=key)


def test_kept_and_empty(spark):
    rows = R.deduplicated(spark.createDataFrame([(1, "x" * 40 + "tail"), (2, "head" + "x" * 40)], "doc_id bigint, text string"), 39).collect()
    assert {(r.doc_id, bytes(r.kept)) for r in rows} == {(1, b"tail"), (2, b"head")}
    assert R.deduplicated(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
