import hashlib

import pytest
import zstandard
from pyspark.sql import functions as F
from tessella.llm import warc as W

BIG = "é" * 600
PAGES = [(1, "http://a/\r\nX: y", BIG), (2, None, BIG), (3, "u", None), (4, "u", ""), (5, "u", BIG + "x"), (6, "u", "s" * 999), (7, "u", "s" * 999), (8, "u", "t" * 1000), (9, "u", "t" * 1000), (10, "u", "WARC/1.1\r\n\r\n" * 300), (11, "u", "z" * 3_000_000), (None, "u", BIG)]


def test_round_trip(spark):
    df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").withColumn("digest", F.lit("x")).repartition(3)
    rows = W.records(W.archived(df)).collect()
    want = {}
    for page, _, html in PAGES:
        payload = (html or "").encode()
        same = [p for p, _, h in PAGES if p and (h or "").encode() == payload] if len(payload) >= 1000 and page else [page]
        last = max(same) if page else page
        want[page] = (len(payload), hashlib.sha1(payload).hexdigest(), "response" if last == page else "revisit", None if last == page else last)
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows} == want and len(rows) == len(PAGES)
    for r in rows:
        html = next(h for p, _, h in PAGES if p == r.page_id)
        assert r.record_type == "revisit" and r.payload is None or bytes(r.payload) == (html or "").encode()


def test_bundle_is_standard_zstandard_and_seekable():
    b = W.Bundle(frame_bytes=500)
    records = {k: W.record(k, "u", bytes([65 + k]) * (100 * k), "d", None, False) for k in range(12)}
    for k, x in records.items():
        b.add(k, x)
    data = b.bytes()
    reader = W.Reader(data)
    assert len(reader.frames) > 3
    for k in (11, 0, 5):
        assert reader.get(k) == records[k]
    assert zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read() == b"".join(records.values())
    assert [h["WARC-Record-ID"] for h, _ in reader] == [f"<urn:page:{k}>" for k in records]
    with pytest.raises(KeyError):
        reader.get(99)
    with pytest.raises(ValueError):
        W.Reader(data[:-1])


def test_small_bundles_and_empty(spark):
    df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    assert W.records(W.bundled(W.planned(df), 2000, 100)).count() == len(PAGES)
    assert W.records(W.archived(df.limit(0))).count() == 0


def test_repeated_ids(spark):
    other = "o" * 2000
    rows = [(1, BIG), (1, BIG), (1, BIG), (2, BIG), (3, BIG), (3, other), (5, other), (5, other), (5, BIG + "y"), (6, "s"), (6, "s")]
    df = spark.createDataFrame([(k, "u", h) for k, h in rows], "page_id bigint, url string, html string").repartition(3)
    got = sorted((r.page_id, r.payload_digest, r.record_type, r.refers_to, r.payload and bytes(r.payload)) for r in W.records(W.archived(df)).collect())
    want = []
    for page, html in rows:
        payload, last = html.encode(), max(p for p, h in rows if h == html)
        again = len(payload) >= 1000 and page != last
        want.append((page, hashlib.sha1(payload).hexdigest(), "revisit" if again else "response", last if again else None, None if again else payload))
    assert got == sorted(want)
