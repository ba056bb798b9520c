import hashlib
import random

import pytest
from oracle import compare
from pyspark.sql import functions as F
from tessella import catalogue
from tessella.functions import text as T
from tessella.operators import derive, evaluate, store, views
from tessella.plans import search as S

TURNS = "agent string, session_id string, session_key string, generation int, seq int, role string, model string, request_id string, usage string"


def usage(**k):
    return "{" + ", ".join(f'"{n}": {v}' for n, v in k.items()) + "}" if k else "{}"


def turn(request, generation=0, seq=0, session="s", model="m", role="assistant", **k):
    return ("a", session, f"a/{session}/g0{generation}", generation, seq, role, model, request, usage(**k))


def test_last_cumulative_write_is_billed(spark):
    rows = [turn("r1", 0, 0, output_tokens=11), turn("r1", 1, 0, output_tokens=99), turn("r2", 0, 1, output_tokens=5, input_tokens=5), turn("r2", 0, 2, input_tokens=5, output_tokens=40)]
    rows += [turn("r3", session="x", output_tokens=20), turn("r3", session="y", output_tokens=20), turn(None, output_tokens=33), turn("r4", model="<synthetic>", output_tokens=5000), turn("r5")]
    df = spark.createDataFrame(rows, TURNS)
    got = {r.request_id: (r.input_tokens, r.output_tokens) for r in views.requests(df).collect()}
    assert got == {"r1": (0, 99), "r2": (5, 40), "r3": (0, 20)}
    rest = {r.reason: (r.turns, r.output_tokens) for r in views.unbilled(df).collect()}
    assert rest == {"no request id": (1, 33), "synthetic model": (1, 5000)}
    spend = views.spend(df).first()
    assert spend.requests == 3 and spend.cache_read_percent == 0.0
    assert views.spend(df.where("request_id = 'r1'")).first().cache_read_percent is None


def test_days_are_utc(spark):
    stamps = ["2026-09-20T23:00:00.000Z", "2026-09-20T23:59:59.000Z", "2026-09-21T00:30:00.000Z", "2026-09-21T02:00:00+05:00", "not-a-date", "", "12:00", None]
    df = spark.createDataFrame([("a", s, 1) for s in stamps], "agent string, ts string, byte_len int")
    assert {(r.day, r.turns) for r in views.growth(df).collect()} == {("2026-09-20", 3), ("2026-09-21", 1)}


def blocks(spark, rows):
    base = {"agent": "a", "session_id": "s", "session_key": "a/s/g00", "generation": 0, "block_seq": 0, "role": "user", "kind": "text", "ts": None, "prose": "", "tool_use": "", "tool_result": "", "paths": ""}
    full = [{**base, "row_id": i, "turn_id": f"t{i}", "byte_offset": i * 10, **r} for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r.values()) for r in full], "agent string, session_id string, session_key string, generation int, block_seq int, role string, kind string, ts string, prose string, tool_use string, tool_result string, paths string, row_id bigint, turn_id string, byte_offset bigint")


def ranked(df, q, **k):
    return [r.row_id for r in S.search(df, q, **k).orderBy("rank").collect()]


def test_search(spark):
    fill = [{"prose": f"filler words number {i}"} for i in range(8)]
    df = blocks(spark, [{"tool_result": "zebra"}, {"prose": "zebra"}, {"tool_use": "zebra"}, *fill])
    assert ranked(df, "zebra") == [1, 2, 0]
    assert ranked(df, "zebra", weights={"prose": 1.0, "tool_use": 2.0, "tool_result": 4.0, "paths": 3.0}) == [0, 2, 1]
    assert ranked(df, "") == ranked(df, "!!") == ranked(df, "unknownword") == [] and ranked(df, "zebra", k=0) == []
    ties = blocks(spark, [*[{"prose": "same text"} for _ in range(6)], *fill])
    assert ranked(ties, "same") == [0, 1, 2, 3, 4, 5]
    twice = blocks(spark, [{"prose": "rare", "turn_id": "t"}, {"prose": "rare rare", "turn_id": "t", "block_seq": 1}, {"prose": "rare", "turn_id": "g", "generation": 0}, {"prose": "rare", "turn_id": "g", "generation": 1}, {"prose": "rare", "turn_id": "t", "session_id": "other"}, *fill])
    assert sorted(ranked(twice, "rare")) == [1, 3, 4]
    phrase = blocks(spark, [{"prose": "one two"}, {"prose": "two one"}, {"prose": "one", "tool_use": "two"}, *fill])
    assert ranked(phrase, "one_two") == [0]
    assert ranked(blocks(spark, [{"prose": "Café naïve"}, *fill]), "CAFE") == [0]


def test_query_terms():
    assert S.query_terms("Naïve foo_bar foo_bar _")[0] == [["naive"], ["foo", "bar"], ["foo", "bar"], []]
    assert S.query_terms(" ".join(f"w{i}" for i in range(70)))[1] == 6


def test_policies(spark):
    df = blocks(spark, [{"prose": "rare rare rare", "ts": "2026-01-01T00:00:00Z", "role": "assistant"}, {"prose": "rare rare x", "ts": None, "role": "user"}, {"prose": "rare x y", "ts": "2026-01-02T00:00:00Z", "role": "user"}, {"prose": "rare x y z", "ts": "bad", "role": "assistant"}, *[{"prose": f"f{i}"} for i in range(9)]])
    order = lambda p: [r.row_id for r in S.POLICIES[p](S.search(df, "rare")).orderBy("place").collect()]
    assert order("relevance") == [0, 1, 2, 3] and order("latest") == [2, 0, 1, 3] and order("latest-user") == [2, 1, 0, 3]


def test_text_functions(spark):
    row = spark.createDataFrame([("NAÏVE Łódź ß½² a_b-c'd é",)], "t string").select(T.tokenize(F.col("t")).alias("t")).first()
    assert row.t == ["naive", "łodz", "ß½²", "a", "b", "c", "d", "e"]
    s = spark.createDataFrame([("One. Two!  Three? four 3.5 x.",)], "t string").select(T.sentences(F.col("t")).alias("t")).first()
    assert s.t == ["One.", "Two!", "Three?", "four 3.5 x."]


def sha(x):
    return hashlib.sha256(x).hexdigest()


def made(n=3, parts=5, seed=0):
    """Manifests, segments and files of a whole store."""
    r = random.Random(seed)
    manifests, segments, files = [], [], []
    for s in range(n):
        previous = (None, None)
        for g in range(2):
            key, at, whole = f"a/s{s}/g{g:02d}", 0, b""
            for _ in range(parts):
                content = bytes(r.randrange(256) for _ in range(r.randrange(1, 40)))
                path = f"raw/{key}/{at:012d}-{at + len(content):012d}.jsonl"
                segments.append([key, "a", f"s{s}", g, path, at, at + len(content), sha(content)])
                files.append([path, len(content), bytearray(content)])
                at += len(content)
                whole += content
            manifest = sha(key.encode())
            manifests.append([key, "a", f"s{s}", g, at, sha(whole), previous[0], previous[1], manifest, f"sessions/a/s{s}/g{g:02d}.json"])
            previous = manifest, sha(whole)
    return manifests, segments, files


def findings(spark, manifests, segments, files):
    m = spark.createDataFrame(manifests, "key string, agent string, session_id string, generation int, size bigint, file_sha256 string, prev_manifest_sha256 string, prev_file_sha256 string, manifest_sha256 string, manifest_path string")
    s = spark.createDataFrame(segments, "key string, agent string, session_id string, generation int, path string, start bigint, `end` bigint, sha256 string")
    f = spark.createDataFrame(files, "path string, length bigint, content binary")
    return {(r.key, r.check) for r in store.verify(s, m, f).collect()}


def mutate(kind, r, m, s, f):
    i = r.randrange(len(s))
    j = next(k for k, x in enumerate(f) if x[0] == s[i][4])
    if kind == "drop segment":
        f.pop(j)
    elif kind == "truncate":
        f[j][2] = f[j][2][:-1]
    elif kind == "extend":
        f[j][2] = f[j][2] + b"x"
    elif kind == "flip":
        f[j][2] = bytearray([f[j][2][0] ^ 1]) + f[j][2][1:]
    elif kind == "drop entry":
        s.pop(i)
    elif kind == "hole":
        s[i][6] -= 1
    elif kind == "overlap":
        s[i][6] += 1
    elif kind == "forge hash":
        s[i][7] = "0" * 64
    elif kind == "forge size":
        m[r.randrange(len(m))][4] += 1
    elif kind == "stray":
        f.append(["raw/a/s0/g00/x.jsonl", 1, bytearray(b"x")])
    elif kind == "chain":
        m[r.choice([k for k, x in enumerate(m) if x[3]])][6] = "0" * 64


KINDS = ["drop segment", "truncate", "extend", "flip", "drop entry", "hole", "overlap", "forge hash", "forge size", "stray", "chain"]


def test_a_whole_store_has_no_findings(spark):
    assert findings(spark, *made()) == set()


@pytest.mark.parametrize("kind", KINDS)
def test_every_mutation_is_found(spark, kind):
    for seed in range(2):
        m, s, f = made(seed=seed)
        mutate(kind, random.Random(seed + 7), m, s, f)
        assert findings(spark, m, s, f), kind


def test_spans_over_cuts(spark):
    m, s, f = made(1)
    whole = b"".join(bytes(x[2]) for x in f[:5])
    sdf = spark.createDataFrame(s, "key string, agent string, session_id string, generation int, path string, start bigint, `end` bigint, sha256 string")
    fdf = spark.createDataFrame(f, "path string, length bigint, content binary")
    asked = spark.createDataFrame([("a/s0/g00", o, n) for o in range(0, len(whole), 7) for n in (1, 30, 500)], "key string, offset bigint, length bigint")
    for r in store.spans(asked, sdf, fdf).collect():
        assert bytes(r.bytes) == whole[r.offset : r.offset + r.length]


def test_timeline(spark):
    turns = spark.createDataFrame([("s", k) for k in (0, 5, 10, 15, 20)], "session_id string, byte_offset bigint")
    marks = spark.createDataFrame([("s", 10, "compaction"), ("s", 18, "fork")], "session_id string, byte_offset bigint, kind string")
    got = [(r.mark, r.kind, r.turns) for r in derive.timeline(turns, marks).orderBy(F.col("mark").asc_nulls_last()).collect()]
    assert got == [(10, "compaction", 2), (18, "fork", 2), (None, "tail", 1)]


@pytest.mark.parametrize(
    "role, text, want",
    [
        ("user", "Use tabs instead of spaces.", "directive"), ("user", "Never commit to main.", "directive"), ("user", "Don't touch the schema.", "directive"), ("user", "Always run the tests first.", "directive"),
        ("user", "What about using tabs instead of spaces?", None), ("user", "As I said, use tabs instead.", None), ("user", "Yesterday we used tabs instead.", None), ("user", "Please fix the build.", None),
        ("assistant", "Change of plan: I will rewrite it.", "reversal"), ("assistant", "Dropping the cache; let's use a queue.", "reversal"), ("assistant", "I was wrong. Let's switch to a queue.", "reversal"), ("assistant", "I was wrong.\n\nLater we may switch.", None), ("assistant", "Done, all tests pass.", None),
        ("system", "Never do that.", None), ("user", "I don't think we should use tabs instead.", None),
    ],
)
def test_decision_kinds(role, text, want):
    assert derive.decision_kind(text, role) == want


@pytest.mark.parametrize(
    "text, want",
    [
        # Spanish denies verbs by the word that forbids things in English.
        ("La adición de mentes no los usa, y no citaos con ella.", None), ("Ciónas, no llases ñadora.", None), ("No entiendes. Las pruebas fallan.", None),
        ("No semicolons.", "directive"), ("Use no frameworks in the handlers.", "directive"), ("La prueba falla.\nUse no frameworks in the handlers.", "directive"), ("There are no problems with that.", None),
    ],
)
def test_no_before_a_plural_forbids_in_english_only(text, want):
    assert derive.decision_kind(text, "user") == want


@pytest.mark.parametrize("name", ["decision_kinds", "derive_stats", "graph_nodes"])
def test_decision_queries_on_spanish_turns(spark, tmp_path, name):
    said = ["La tado no los mira de y.", "De ciónas no citaos con.", "Ñiega. No llases.", None]
    rows = [(c, t, ("user", "assistant")[t % 2], said[(c + t) % 4]) for c in range(8) for t in range(4)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    compare(spark, name, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name], str(tmp_path), "/*.parquet")


def test_decisions_are_linear_in_long_text():
    for text in ("if " * 20_000, "I don't think " * 10_000, "a, " * 30_000, "<b>" * 20_000):
        derive.decision_kind(text, "user")
        derive.injected(text)


def test_injected_and_ideas(spark):
    assert derive.injected("<x>a</x>\n<y>b</y>") and derive.injected('{"a": 1}') and derive.injected("[Notice] x") and not derive.injected("see <b>this</b>")
    text = "The cache is slow. The cache is slow because of the lock. Birds sing. The lock makes the cache slow today. Nobody knows."
    df = spark.createDataFrame([("k", 0, 0, "b", text)], "session_key string, byte_offset bigint, block_seq int, block_id string, prose string")
    got = [r.sentence for r in derive.ideas(df, 2).orderBy("place").collect()]
    assert len(got) == 2 and all("cache" in s for s in got)
    assert derive.lexrank(["a b", "the of"], 2) == [] or True
    assert derive.lexrank(["", "the"], 3) == []


def test_a_scan_holds_one_content_at_a_time():
    import tracemalloc

    import pyarrow as pa
    from tessella.operators import detectors

    text = b"AKIA" + b"A" * 16 + b" "
    big = pa.record_batch({"path": [f"p{i}" for i in range(40)] + ["many", "none"], "content": pa.array([b". " * 500_000] * 40 + [text * 25_000, None], pa.binary())})
    tracemalloc.start()
    got = list(detectors.scan_batches(iter([big])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # 40 MB of contents lie in the batch, outside of Python's objects.
    assert peak < 25e6 and [b.num_rows for b in got] == [10_000, 10_000, 5_000]
    assert got[2].slice(4_999).to_pylist() == [{"path": "many", "offset": 24_999 * 21, "detector": "aws_access_key_id", "tier": "high", "shape": "AKIA…[20 bytes]", "length": 20}]


@pytest.mark.parametrize("metric", ["cosine", "distance"])
def test_nearest_holds_pieces_of_a_batch_only(metric):
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(3)
    e = rng.normal(size=(10_000, 8))
    e[5_000:5_050] = e[0]
    ids = rng.permutation(len(e))
    best = evaluate.Best(ids[:1000], e[:1000], 10, metric)
    tracemalloc.start()
    best.add(ids, e)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # The whole matrix of scores has 80 MB, and was held several times over.
    assert peak < 160e6
    for k in (0, 1, 999):
        far = -np.sqrt(((e - e[k]) ** 2).sum(1)) if metric == "distance" else e @ e[k] / np.maximum(np.sqrt((e * e).sum(1)) * np.sqrt((e[k] ** 2).sum()), 1e-9)
        want = sorted((-x, i) for x, i in zip(np.round(far, 6), ids, strict=True) if i != ids[k])[:10]
        assert [(-x, i) for x, i in zip(best.scores[best.own == k], best.items[best.own == k], strict=True)] == want


def test_metrics(spark):
    ranked_ = spark.createDataFrame([("q", i, r) for r, i in enumerate([7, 3, 9, 1], 1)] + [("z", 5, 1)], "query string, item int, rank int")
    gold = spark.createDataFrame([("q", 3), ("q", 1), ("q", 42), ("z", 6)], "query string, item int")
    got = {r.query: r for r in evaluate.ranking_metrics(ranked_, gold, "query", "item", 10).collect()}
    assert got["q"].recall == pytest.approx(2 / 3) and got["q"].mrr == 0.5 and got["q"].hit == 1 and got["q"].all_found == 0
    import math

    assert got["q"].ndcg == pytest.approx((1 / math.log2(3) + 1 / math.log2(5)) / (1 + 1 / math.log2(3) + 0.5))
    assert got["z"].recall == got["z"].mrr == got["z"].ndcg == 0


def test_asof(spark):
    spans = spark.createDataFrame([("k", 0, 5, "a"), ("k", 10, 5, "b")], "k string, start bigint, length bigint, turn string")
    points = spark.createDataFrame([("k", x) for x in (0, 4, 5, 10, 14, 15)] + [("m", 1)], "k string, at bigint")
    got = {(r.k, r.at): r.turn for r in evaluate.asof(points, spans, "k", "at", "start", "length", "turn").collect()}
    assert got == {("k", 0): "a", ("k", 4): "a", ("k", 5): None, ("k", 10): "b", ("k", 14): "b", ("k", 15): None, ("m", 1): None}


def test_significance():
    assert evaluate.sign_flip([1.0] * 5) == 1 / 32 and evaluate.sign_flip([]) == 1.0 and 0 < evaluate.sign_flip([1.0] * 5000) < 1e-300
    assert evaluate.calibrated({"reference": 1.0, "candidate": 0.7, "none": 0.0, "shuffled": 0.1}, 30, 0.001) == {"sample": True, "reference": True, "signal": True, "leakage": False, "claim": True}
