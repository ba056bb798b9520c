import json
import os

import pytest
from pyspark.sql import functions as F
from tessella.engine import Engine, read_span
from tessella.functions import text as T
from tessella.operators import store
from tessella.sources import benchmarks


def test_from_bytes_to_answers(spark, tmp_path):
    os.makedirs(f"{tmp_path}/in")
    lines = [
        {"type": "user", "uuid": "u1", "sessionId": "s", "timestamp": "2026-01-01T00:00:00Z", "message": {"content": "Never use the zebra library in src/app/main.py."}},
        {"type": "assistant", "uuid": "u2", "requestId": "r1", "timestamp": "2026-01-01T00:01:00Z", "message": {"model": "m", "usage": {"input_tokens": 4, "output_tokens": 9}, "content": [{"type": "text", "text": "Dropping zebra; let's use a horse instead."}]}},
        {"type": "user", "uuid": "u3", "timestamp": "2026-01-02T00:00:00Z", "message": {"content": "thanks"}},
        {"type": "user", "uuid": "u4", "timestamp": "2026-01-02T00:00:00Z", "message": {"content": "more"}},
    ]
    data = "".join(json.dumps(x) + "\n" for x in lines)
    with open(f"{tmp_path}/in/log.jsonl", "w") as f:
        f.write(data)
    e = Engine(spark, f"{tmp_path}/home")
    e.capture(f"{tmp_path}/in").awaitTermination(120)
    assert e.verify().count() == 0 and e.gate()
    e.index()
    hits = e.recall("zebra").orderBy("place").collect()
    assert [h.role for h in hits] == ["user", "assistant"] and "main.py" in hits[0].paths
    key = hits[0].session_key
    assert json.loads(read_span(e, key, hits[0].byte_offset, hits[0].byte_len))["uuid"] == "u1"
    assert [(r.model, r.output_tokens) for r in e.spend().collect()] == [("m", 9)] and e.unbilled().count() == 0
    assert {(r.day, r.turns) for r in e.growth().collect()} == {("2026-01-01", 2), ("2026-01-02", 2)}
    nodes, edges = e.graph()
    assert [n.decision for n in nodes.orderBy("byte_offset").collect()] == ["directive", "reversal"] and edges.count() == 1
    assert e.timeline().first().turns == 4 and e.ideas(1).count() == 1

    e.seal()
    assert e.verify().count() == 0
    m = e.manifests().first()
    assert json.loads(m.body)["size"] == len(data) and m.manifest_path == f"sessions/agent-a/{m.session_id}/g00.json"
    assert e.recall("zebra", policy="policies_for_tests:oldest").count() == 2
    with pytest.raises(ValueError):
        e.recall("zebra", policy="nonsense")
    assert e.retriever()("zebra", 1) == [hits[0].byte_offset] if hits[0].rank == 1 else [hits[1].byte_offset]
    stats = e.derive().first()
    assert (stats.generations, stats.marks, stats.decisions) == (1, 0, 2) and e.artefacts().count() == 3
    assert e.corpus().first().turns == 4 and e.contiguity().first().segments == 1 and e.requests().count() == 1 and e.unmeasured().count() > 0 and e.sessions().count() == 1
    # More bytes than the seal says, and a manifest that was changed by hand.
    with open(f"{tmp_path}/in/log.jsonl", "a") as f:
        f.write('{"type": "user"}\n')
    e.capture(f"{tmp_path}/in").awaitTermination(120)
    assert "size" in {r.check for r in e.verify().collect()}
    e.seal()
    assert e.verify().count() == 0
    forged = e.manifests().withColumn("body", F.regexp_replace("body", '"size":[0-9]+', '"size":true'))
    found = {r.check for r in store.verify(e.segments(), forged, e.segments().select("path", "content")).collect()}
    assert found == {"manifest type", "manifest hash"}


def test_benchmarks(spark, tmp_path):
    one = {"question_id": "q1", "question_type": "t", "question": "?", "answer": "a", "question_date": "d", "haystack_dates": ["x"], "haystack_session_ids": ["s1"], "haystack_sessions": [[{"role": "user", "content": "hi", "has_answer": True}, {"role": "assistant", "content": "yo"}]], "answer_session_ids": ["s1"]}
    path = f"{tmp_path}/q.json"
    with open(path, "w") as f:
        json.dump([one, {**one, "question_id": "q2_abs"}], f)
    df = benchmarks.instances(spark, path)
    assert benchmarks.answered(df).count() == 1 and benchmarks.gold_sessions(df).count() == 2
    assert [(r.session_id, r.turn, r.has_answer) for r in benchmarks.turns(df.where("question_id = 'q1'")).collect()] == [("s1", 0, True), ("s1", 1, False)]
    with open(path, "w") as f:
        json.dump([one, one], f)
    with pytest.raises(ValueError):
        benchmarks.instances(spark, path)
    q = spark.createDataFrame([("q", ["D1:2; D9:9", "D3:4"])], "question_id string, evidence array<string>")
    good, bad = benchmarks.evidence(q, spark.createDataFrame([("D1:2",), ("D3:4",)], "turn_id string"))
    assert good.count() == 2 and bad.count() == 1


def test_text(spark):
    df = spark.createDataFrame([("a\x1b[2K‮b\tc\n", '{"is_error": true}', '{"correct": "no"} yes'), ("plain", "{}", "Yes."), ("3 failed", "x", "no")], "t string, n string, a string")
    rows = df.select(T.safe_text(F.col("t")).alias("s"), T.looks_failed(F.col("n"), F.col("t")).alias("f"), T.qa_verdict(F.col("a")).alias("v")).collect()
    assert [tuple(r) for r in rows] == [("a\\x1b[2K\\u202eb\tc\n", True, False), ("plain", False, True), ("3 failed", True, False)]
