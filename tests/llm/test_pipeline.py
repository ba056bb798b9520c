import re
import time

import numpy as np
import public_tokenizers as P
from tessella.llm import shingle_join
from tessella.llm.piece_codec import codec

import corpus_pipeline
from tests.llm.test_shingle_join import brute, passages


def corpus(n=140):
    r = np.random.default_rng(11)
    words = [f"{a}{b}" for a in ("lo", "ri", "me", "ta", "so", "vu", "ne", "ka") for b in ("ran", "tel", "mis", "dor", "pel", "quin", "sa", "bo")]
    text = lambda k: " ".join(r.choice(words, k))
    bench = [text(20) for _ in range(3)]
    docs = [[i, text(int(r.integers(80, 200)))] for i in range(n)]
    docs[10][1] = docs[3][1]
    docs[11][1] = docs[3][1] + " extra tail"
    docs[20][1] += " " + bench[1]
    docs[30][1] += " mail some.one@mail.example.com or 10.0.0.1"
    docs[40][1] = "short"
    docs[41][1] = "a b c " * 60
    docs[42][1] = None
    return [(i, t, "en", "s", len(t or "")) for i, t in docs], [(i, b) for i, b in enumerate(bench)]


def test_stages_against_brute_force(spark, tmp_path):
    docs, bench = corpus()
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    gone = {10, 11, 20, 40, 41, 42}
    assert set(rows) == {d[0] for d in docs} - gone
    c = codec(P.path("piece_bpe_32k.model"))
    for i, t, *_ in docs:
        if i not in gone:
            t = re.sub(r"\S+@\S+", "[EMAIL]", t).replace("10.0.0.1", "[IP]")
            assert np.frombuffer(rows[i].ids, "<u4").tolist() == c.library.encode(t, add_bos=True, add_eos=True)
            spans = np.frombuffer(rows[i].spans, "<i4")
            assert spans[0] == 0 and spans[-1] == len(t.encode()) and rows[i].n_tokens == len(spans) // 2 + 2


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    docs, bench = corpus(60)
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, str(tmp_path)).dtypes == df.dtypes
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0


def test_rows_are_judged_apart(spark, tmp_path):
    docs, bench = corpus(60)
    spark.createDataFrame([*bench, (None, "leaked passage")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = [d[1] for d in docs[:6]]
    run = lambda stage, rows: sorted(map(repr, ((r.doc_id, r.text) for r in stage(spark, spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3), str(tmp_path)).collect())))
    want = lambda rows: sorted(map(repr, rows))
    good = [(None, clean[0]), (None, clean[1]), (7, clean[2]), (7, clean[2])]
    assert run(corpus_pipeline.quality_rules, [*good, (None, "short"), (7, "short")]) == want(good)
    assert run(corpus_pipeline.decontamination, [*good, (None, bench[0][1]), (7, "a leaked passage")]) == want(good)
    rows = [(7, clean[2]), (7, clean[2]), (5, clean[2]), (None, clean[2]), (None, clean[0]), (None, clean[0]), (None, clean[1]), (9, clean[3]), (9, clean[4])]
    assert run(corpus_pipeline.near_duplicates, rows) == want([(5, clean[2]), (None, clean[0]), (None, clean[1]), (9, clean[3]), (9, clean[4])])


def test_near_duplicates_ship_few_sets(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(shingle_join, "TILE_NODES", 16)
    rows = passages()
    written = lambda: sum(e.totalShuffleWrite() for e in (lambda x: [x.apply(k) for k in range(x.size())])(spark.sparkContext._jsc.sc().statusStore().executorList(True)))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    before = written()
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).select("doc_id").collect())
    want = brute(rows)
    assert kept == sorted({low for _, _, low in want})
    # As whole sets in all pairs of tiles they took 10 times their bytes.
    assert written() - before < 4 * 8 * sum(n for _, n, _ in want), (written() - before) / (8 * sum(n for _, n, _ in want))


def test_near_duplicates_leave_no_shuffle_files(spark, tmp_path):
    rows = passages(200)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    listed = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    shuffled = lambda: {f.getPath(): f.length() for f in (lambda x: [x.apply(k) for k in range(x.size())])(listed()) if f.getName().startswith("shuffle_")}
    written = lambda: sum(e.totalShuffleWrite() for e in (lambda x: [x.apply(k) for k in range(x.size())])(spark.sparkContext._jsc.sc().statusStore().executorList(True)))
    there, before = set(shuffled()), written()
    corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    left = lambda: sum(n for path, n in shuffled().items() if path.endswith(".data") and path not in there) / (written() - before)
    until = time.time() + 10  # files go a little after the execution
    while left() > 0.2 and time.time() < until:
        time.sleep(0.2)
    # The texts and their shingles, dealt by group and bucket, and the sets of the clusters are stored by now.
    assert left() <= 0.2, left()
