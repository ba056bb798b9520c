import os

from pyspark.sql import functions as F
from tessella.operators import store
from tessella.streaming import capture as K


def whole(spark, path):
    rows = K.segments_of(spark, path).orderBy("session_id", "generation", "start").collect()
    out = {}
    for r in rows:
        at = out.setdefault(r.key, b"")
        assert r.start == len(at) and r.end == r.start + len(r.content)
        out[r.key] = at + bytes(r.content)
    return out


def run(spark, tmp_path):
    K.capture(spark, f"{tmp_path}/in", f"{tmp_path}/store", f"{tmp_path}/ck").awaitTermination(120)
    return whole(spark, f"{tmp_path}/store")


def test_growth_restart_and_rewrite(spark, tmp_path):
    os.makedirs(f"{tmp_path}/in/sub")
    a, b = f"{tmp_path}/in/a.jsonl", f"{tmp_path}/in/sub/b.jsonl"
    write = lambda p, x, mode="ab": open(p, mode).write(x)
    write(a, b'{"n": 1}\n')
    write(b, b"")
    assert list(run(spark, tmp_path).values()) == [b'{"n": 1}\n']
    write(a, b'{"n": 2}\n')
    write(b, b"x\n")
    key = K.session_id(a)
    got = run(spark, tmp_path)
    assert got[f"{key}/g00"] == b'{"n": 1}\n{"n": 2}\n' and got[f"{K.session_id(b)}/g00"] == b"x\n"
    assert run(spark, tmp_path) == got  # nothing new, nothing twice
    write(a, b"rewritten and longer than before\n", "wb")
    got = run(spark, tmp_path)
    assert got[f"{key}/g01"] == b"rewritten and longer than before\n" and len(got) == 3
    segments = K.segments_of(spark, f"{tmp_path}/store").withColumn("path", F.col("start").cast("string"))
    assert store.tiling(segments).count() == 0


def test_a_batch_may_run_twice(spark, tmp_path):
    batch = spark.createDataFrame([("/x/s.jsonl", 3, bytearray(b"abc")), ("/x/s.jsonl", 2, bytearray(b"ab"))], K.TAIL)
    write = K.sink(spark, f"{tmp_path}/store")
    write(batch, 0)
    write(batch.limit(1), 0)
    assert list(whole(spark, f"{tmp_path}/store").values()) == [b"abc"]


def test_due():
    assert K.due(True, True, True, 0) and K.due(True, False, False, 0) and K.due(True, False, True, 4000)
    assert not K.due(True, False, True, 10) and not K.due(False, True, False, 9999)
    assert "PreCompact" in K.FORCED and "Stop" not in K.FORCED
