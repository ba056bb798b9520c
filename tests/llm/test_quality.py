import collections
import math
import re

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tessella.llm import quality as Q
from tessella.llm.piece_codec import codec

PATH = P.path("piece_bpe_32k.model")


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


TEXTS = [None, "", "\n", " \n\n", "a", "a a a a", "é b é b é b x", "x\nx\n\nx \nx", "a\n\na\n", "#*$%&|<> <é>", "one two three one two three", " b\x0bc\x1fd", "line\n" * 50, "w " * 5000, "日本 語\n日本 語"]


def test_counts(spark):
    df = spark.createDataFrame([(i, t, None if i % 2 else "en", 1) for i, t in enumerate(TEXTS)], "doc_id bigint, text string, lang string, n_words int").repartition(2)
    rows = {r.doc_id: r for r in Q.measured(df, PATH).collect()}
    for i, t in enumerate(TEXTS):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t), t
        ids = codec(PATH).library.encode(t or "")
        assert r.n_tokens == len(ids)
        if ids:
            assert r.chars_per_token == 1000 * len(t) // len(ids)
            h = -sum(c / len(ids) * math.log2(c / len(ids)) for c in collections.Counter(ids).values()) / math.log2(max(2, len(ids)))
            assert abs(r.token_entropy / 1000 - h) < 0.0021
    assert rows[14].script == "CJK" and rows[4].script == "Latin"


def test_bands(spark):
    r = np.random.default_rng(1)
    words = "the people of town went to market and bought bread with their money before rain came over hills".split()
    docs = [(i, " ".join(r.choice(words, 160)), "en") for i in range(60)]
    docs += [(100, " ".join(f"{chr(0x13000 + k)} {words[k % 18]}" for k in range(25)) + " " + docs[1][1][:150], "en"), (101, None, None), (102, "too short", "en"), (102, "too short", "en"), (103, docs[0][1], None)]
    rows = Q.judged(spark.createDataFrame(docs, "doc_id bigint, text string, lang string"), PATH).collect()
    kept = collections.Counter((r.doc_id, r.kept) for r in rows)
    assert all(kept[(i, True)] == 1 for i in range(60)) and kept[(103, True)] == 1
    bad = next(r for r in rows if r.doc_id == 100)
    assert not bad.base_failed and not bad.kept and "fallback_share" in bad.reasons
    assert kept[(102, False)] == 2 and kept[(101, False)] == 1


def test_empty(spark):
    assert Q.judged(spark.createDataFrame([], "doc_id bigint, text string, lang string"), PATH).count() == 0


def test_rare_lengths_and_languages(spark):
    r = np.random.default_rng(2)
    words = "the people of town went to market and bought bread with their money before rain came over hills".split()
    greek = "οι άνθρωποι της πόλης πήγαν στην αγορά και αγόρασαν ψωμί με τα χρήματά τους πριν έρθει η βροχή".split()
    docs = [(i, " ".join(r.choice(words, 160)), "en") for i in range(40)]
    docs += [(100, " ".join(f"{w}{i}%%%" for i, w in enumerate(r.choice(words, 2000))), "en")]
    docs += [(200 + i, " ".join(r.choice(greek, 120)), "el") for i in range(3)]
    rows = {x.doc_id: x for x in Q.judged(spark.createDataFrame(docs, "doc_id bigint, text string, lang string"), PATH).collect()}
    assert not any(x.base_failed for x in rows.values()) and rows[100].n_tokens >= 4096
    assert not rows[100].kept and all(rows[i].kept for i in rows if i != 100)
