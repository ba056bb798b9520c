"""Every operator on the rows that go wrong first: nulls, repeated rows, empty tables, one huge text, columns whose names clash."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tessella.llm import attribution, decontaminate, main_text, personal_data, piece_codec, quality, repeated_bytes, secrets, shingle_join, warc

PIECES = public_tokenizers.path("piece_bpe_32k.model")
_r = np.random.default_rng(1)
HUGE = " ".join(_r.choice(["alpha", "beta", "gamma.", "token=abcdef1234", "a@b.cd", "+1 555 010 1234", "é\n"], 60_000))
ROWS = [(1, "one two three four five six"), (1, "one two three four five six"), (1, "other text of the same id"), (None, None), (None, None), (None, "x"), (2, ""), (3, None), (4, " \n\t"), (5, HUGE), (6, "\x00\x1f ﬁ \U0001f600"), (2**62, "big id")]
#: Names that operators use inside.
CLASHES = ("g", "b", "node", "n", "band", "kind", "lang_", "base", "all", "tests", "count", "html", "k", "key", "segment", "items", "starts", "ends", "spans_", "row_key", "h", "label", "label_", "digest")

DOCS = {
    "decontamination": lambda d: decontaminate.contamination(d, d.sparkSession.createDataFrame([(1, "alpha beta alpha"), (None, None), (None, "x")], "item_id bigint, text string")),
    "decontamination in blocks": lambda d: decontaminate.contamination(d, d.sparkSession.createDataFrame([(1, "alpha beta alpha"), (2, "x"), (None, "six")], "item_id bigint, text string"), block_bytes=20),
    "token counts": lambda d: attribution.counted(d, public_tokenizers.path("byte_bpe_50k.tiktoken")),
    "quality": lambda d: quality.judged(d, PIECES),
    "quality without languages": lambda d: quality.judged(d, PIECES, lang_column=None),
    "secrets": secrets.spans,
    "repeated bytes": repeated_bytes.deduplicated,
    "shingles": shingle_join.classes,
    "personal data": personal_data.spans,
    "pieces": lambda d: piece_codec.encoded(d, PIECES),
}
PAGES = {"main text": main_text.extracted, "main text in shards": lambda d: main_text.extracted(d, shard_bytes=1000), "warc": lambda d: warc.records(warc.archived(d))}


def clashing(df, own):
    return df.select("*", *(F.lit(1).alias(c) for c in CLASHES if c not in own))


@pytest.mark.parametrize("name", DOCS)
def test_documents(spark, name):
    df = clashing(spark.createDataFrame([(i, t, None if i == 1 else "en") for i, t in ROWS], "doc_id bigint, text string, lang string").repartition(3), ("lang",))
    got = DOCS[name](df)
    assert sorted(str(r.doc_id) for r in got.select("doc_id").collect()) == sorted(str(i) for i, _ in ROWS)
    assert DOCS[name](df.limit(0)).count() == 0


@pytest.mark.parametrize("name", PAGES)
def test_pages(spark, name):
    rows = [(i, None if i is None else f"http://h/{i}", t) for i, t in ROWS]
    df = clashing(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3), ("html",))
    got = PAGES[name](df)
    assert sorted(str(r.page_id) for r in got.select("page_id").collect()) == sorted(str(i) for i, _ in ROWS)
    assert PAGES[name](df.limit(0)).count() == 0
