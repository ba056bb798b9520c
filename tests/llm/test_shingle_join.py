import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessella.llm import shingle_join as S
from tessella.llm.components import components


def sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))}


def brute(rows):
    got = [(d, sets(t)) for d, t in rows]
    label = list(range(len(got)))
    for i in range(len(got)):
        for j in range(i):
            a, b = got[i][1], got[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b) and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    low = {c: min((got[k][0] for k in range(len(got)) if label[k] == c and got[k][0] is not None), default=None) for c in set(label)}
    return [(d, len(s), low[label[k]]) for k, (d, s) in enumerate(got)]


def corpus(seed, n=160):
    r = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = " ".join(r.choice(vocabulary, 25))
    rows = []
    while len(rows) < n:
        base = list(r.choice(vocabulary, int(r.integers(1, 120))))
        for _ in range(int(r.choice([1, 1, 2, 8]))):
            text = base.copy()
            for _ in range(int(r.integers(0, 4))):
                text[int(r.integers(len(text)))] = str(r.choice(vocabulary))
            if r.random() < 0.3:
                text.append(passage)
            rows.append((len(rows) * 3, "  ".join(text).upper() if r.random() < 0.2 else "\n".join(text)))
    return rows


EDGE = [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "ONE\ttwo"), (905, "one two three"), (905, "one two three"), (None, "one two three"), (None, None)]


@pytest.mark.parametrize("seed, tile, group", [(1, 4096, 2 << 20), (2, 4, 3000)])
def test_against_brute_force(spark, monkeypatch, seed, tile, group):
    monkeypatch.setattr(S, "TILE_NODES", tile)
    monkeypatch.setattr(S, "GROUP_BYTES", group)
    rows = corpus(seed) + EDGE
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("node", F.lit(1)).repartition(5)
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted([tuple(x) for x in S.classes(df).collect()], key=key) == sorted(brute(rows), key=key)


def passages(n=600):
    """Texts that common passages hold together, with near copies of some; few of them link."""
    r = np.random.default_rng(5)
    pool = [" ".join(f"p{k}w{i}" for i in range(20)) for k in range(60)]
    rows = []
    while len(rows) < n:
        base = r.choice(60, 8, replace=False)
        for k in range(int(r.choice([1, 1, 3]))):
            own = base.copy()
            own[:k] = r.choice(60, k)
            rows.append((len(rows), " ".join(pool[x] for x in own)))
    return rows[:n]


def test_large_clusters_ship_few_sets(spark, monkeypatch):
    monkeypatch.setattr(S, "TILE_NODES", 16)
    rows = passages()
    written = lambda: sum(e.totalShuffleWrite() for e in (lambda x: [x.apply(k) for k in range(x.size())])(spark.sparkContext._jsc.sc().statusStore().executorList(True)))
    before = written()
    got = S.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(tuple(x) for x in got) == sorted(brute(rows))
    # As whole sets in all pairs of tiles they took 10 times their bytes, even compressed.
    sets_bytes = 8 * sum(x.n_shingles for x in got)
    assert written() - before < 4 * sets_bytes, (written() - before) / sets_bytes


def test_bounds_hold_between_widths():
    r = np.random.default_rng(3)
    pool = np.sort(r.integers(0, 1 << 63, 400).astype(np.uint64))
    sets = [np.sort(r.choice(pool, int(n), replace=False)) for n in r.integers(1, 300, 60)]
    tile = S.Tile(np.arange(60), sets, np.full(60, 2), np.arange(60), 75)
    assert len(tile.block) > 3
    for i in range(1, 60):
        others = np.arange(i)
        assert (tile._most(i, others) >= tile._common(i, others)).all()


def test_empty(spark):
    assert S.classes(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_components(spark):
    r = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in r.integers(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in range(70)]
    got = dict(components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect())
    label = {x: x for p in pairs for x in p}
    for _ in range(400):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert all(got.get(k, k) == v for k, v in label.items())
