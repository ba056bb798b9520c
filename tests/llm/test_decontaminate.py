import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from oracle import compare
from tessella.llm import decontaminate as D
from tessella.llm.oracle import ORACLE_SQL

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, n=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - n + 1, min(len(w), 1))):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    sizes = {len(x) for x in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for i in range(len(w)):
            for k in sizes:
                if items_of := windows.get(tuple(w[i : i + k])) if i + k <= len(w) else None:
                    hit |= set(range(i, i + k))
                    found |= items_of
        out.append((doc, len(w), len(hit), sorted(found - {None}), None in found))
    return out


DOCS = [
    (1, "One two three four five six seven eight nine TEN eleven twelve"),
    (2, None),
    (3, ""),
    (4, "x-one two,three four five six seven eight nine ten."),
    (5, "one two three"),
    (6, "é ü ñ short item here é ü"),
    (7, "a b " * 2000 + "one two three four five six seven eight nine ten eleven"),
    (8, "ten eleven one two"),
    (9, "..."),
    (9, "..."),
    (None, "short item"),
]
ITEMS = [(10, "one two three four five six seven eight nine ten eleven"), (2, "short item"), (30, ""), (4, None), (5, "a b a b a b a b a b"), (6, "short  ITEM"), (None, "ten eleven"), (7, "seven eight nine ten eleven one two three four five six")]


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_against_brute_force(spark, block):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string").withColumn("items", F.lit("x")).withColumn("unnamed", F.lit("x"))
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = D.contamination(docs, items, block_bytes=block).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute(DOCS, ITEMS)))


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert D.contamination(docs.limit(0), items).count() == 0
    assert {r.n_hit for r in D.contamination(docs, items.limit(0)).collect()} == {0}


def test_random_windows(spark):
    r = np.random.default_rng(3)
    text = lambda n: " ".join(r.choice(["aa", "b", "cc", "d"], n))
    docs = [(i, text(int(r.integers(0, 300)))) for i in range(60)]
    items = [(i, docs[i][1][: int(r.integers(5, 90))]) for i in range(20)]
    got = D.contamination(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), length=5)
    assert sorted(tuple(x) for x in got.collect()) == brute(docs, items, 5)


def test_proximity(spark):
    import pandas as pd

    docs = spark.createDataFrame([(1, "red x blue y green"), (2, "green blue red"), (3, "red " + "z " * 30 + "blue green"), (4, "red"), (5, "blue green")], "doc_id bigint, text string")
    got = D.searched(D.indexed(docs), pd.DataFrame({"id": [7], "text": ["red blue green"]}), slop=2).collect()
    assert sorted(r.id for r in got if r["items"]) == [1, 2]


def test_query(spark, tmp_path):
    from tessella.llm.queries import QUERIES

    spark.createDataFrame(DOCS[:8], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    compare(spark, "op2", QUERIES["op2_decontamination"], ORACLE_SQL["op2_decontamination"], str(tmp_path), "/*.parquet")
    rows = {r.doc_id: r for r in QUERIES["op2_decontamination"](spark, str(tmp_path)).collect()}
    want = {r[0]: r for r in brute(DOCS[:8], ITEMS)}
    assert want[8][2:] == (2, [], True)
    for k, r in rows.items():
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (want[k][1], want[k][2], len(want[k][3]) + want[k][4], want[k][2] > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(map(str, want[k][3]))).encode()).hexdigest()


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_rows_stay_apart(spark, block):
    rows = [*DOCS, (None, "clean text"), (None, None), (1, "another text of this id"), (9, "short item")]
    items = [*ITEMS, (None, "clean"), (2**60 + 1, "another text")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = D.contamination(docs, spark.createDataFrame(items, "item_id bigint, text string"), block_bytes=block).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute(rows, items)))
