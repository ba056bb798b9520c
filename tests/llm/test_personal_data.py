import re

import numpy as np
from pyspark.sql import functions as F
from tessella.llm import native as N
from tessella.llm import personal_data as P


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 * (int(c) > 4)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    text = text or ""
    d = lambda m: re.sub("[^0-9]", "", m[0])
    out = [[m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]]
    out.append([m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))])
    out.append([m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(d(m)) <= 19 and luhn(d(m))])
    out.append([m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(d(m)) <= 15])
    return out


TEXTS = [
    None, "", "é a@b.c x", "a@b.c_d@e.f a@b @c.d a@@b.c x.y@z-1.com.", "a@b.com.x@y.z 1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.255 1.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 12345678901234567890 00000000000000", "+1 (555) 010-1234 ++1 5550101234) +12 +1 555 010 1234 567 8901 +1.(((((",
    "1" * 3000, "a." * 3000 + "@b.c", "𝒳" * 10 + "+49 30 1234567 é@ü.de q@ü.de w@u.de", "9 9 9 9 9 9 9 9 9 9 9 9 9 9 9 9 4 1 1 1", "1.1.1.1" * 600, "1 2\n3",
]


def random_texts(n=300):
    r = np.random.default_rng(5)
    alphabet = list("0123456789..  --+@abé()_")
    return ["".join(r.choice(alphabet, int(r.integers(0, 120)))) for _ in range(n)]


def test_base_against_brute_force(spark):
    texts = TEXTS + random_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("base", F.lit(1))
    for r in P.spans(df).collect():
        got = [[(s.start, s.end) for s in r[k]] for k in P.BASE]
        assert got == brute(texts[r.doc_id]), texts[r.doc_id]
        want = sorted((s, k, e) for k, x in enumerate(brute(texts[r.doc_id])) for s, e in x)
        assert [(s.start, s.order, s.end) for s in r["base"]] == want
        assert set(want) <= {(s.start, s.order, s.end) for s in r["all"]}
        for s in r["all"]:
            assert s.kind in P.BASE or not any(s.start < e and b < s.end for b, _, e in want)


def test_candidates(spark):
    texts = {
        1: "My SSN is 123-45-6789 thanks", 2: "order 123-45-6789", 3: "please call (555) 234-5678 now", 4: "IBAN DE89 3704 0044 0532 0130 00 please", 5: "ref DE88 3704 0044 0532 0130 00 x", 6: "born 12/05/1980 in", 7: "version released 12/05/2020", 8: "date of birth: 45/99/1980",
        9: "write to jane.doe (at) example (dot) org today", 10: "she lives at 12 Oak Street with her son", 11: "login from 2001:db8::1f2 failed", 12: "time 12:30:45 on the clock", 13: "in 1929 Wall Street crashed",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: [(s.kind, texts[r.doc_id][s.start : s.end]) for s in r["all"]] for r in P.spans(df).collect()}
    assert got[1] == [("national", "123-45-6789")] and got[3] == [("local_phone", "(555) 234-5678")]
    assert got[4] == [("account", "DE89 3704 0044 0532 0130 00")] and got[6] == [("birth_date", "12/05/1980")]
    assert got[9] == [("written_mail", "jane.doe (at) example (dot) org")] and got[10] == [("address", "12 Oak Street")] and got[11] == [("ipv6", "2001:db8::1f2")]
    assert got[2] == got[7] == got[5] == got[12] == got[13] == []


def test_model_on_held_out_sentences(spark):
    boosted, limits = P.model(spark)
    x, y, _ = P.labelled(spark, P.sentences(4000, 77))
    p = boosted.probability(x)
    assert ((p > 0.5) == (y == 1)).mean() > 0.9
    for lo in (0.0, 0.4, 0.8):
        own = (p >= lo) & (p < lo + 0.2)
        assert own.sum() < 30 or abs(p[own].mean() - y[own].mean()) < 0.15
    for k, kind in enumerate(P.CANDIDATES):
        own = x[:, k] == 1
        taken = own & (p >= limits[kind])
        assert y[taken].mean() > 0.9 and y[taken].sum() > 0.7 * y[own].sum(), kind


def overlap(a, b):
    return a[0] < b[1] and b[0] < a[1]


def test_chosen_spans_against_brute_force(spark):
    boosted, limits = P.model(spark)
    made = P.sentences(600, 5)
    r = np.random.default_rng(3)
    joined = [" ".join(made[int(i)][0] for i in r.integers(0, len(made), int(r.integers(1, 12)))) for _ in range(120)] + [t for t in TEXTS if t]
    df = spark.createDataFrame(list(enumerate(joined)), "doc_id bigint, text string")
    found = df.select("doc_id", F.explode(P.candidates(F.col("text"))).alias("c"), "text").select("doc_id", "c.*", P.described(F.col("text"), F.col("c")).alias("x")).collect()
    proposed = {}
    for c in found:
        pattern = list(P.CANDIDATES.values())[c.order][2]
        assert (c.start, c.end) in [m.span() for m in re.finditer(pattern, joined[c.doc_id])] and c.end - c.start <= P.LONGEST
        p = boosted.probability(np.array([c.x]))[0]
        if p >= list(limits.values())[c.order]:
            proposed.setdefault(c.doc_id, []).append((-p, c.order, c.start, c.end))
    names, some = list(P.CANDIDATES), 0
    for row in P.spans(df).collect():
        taken = []
        bare = [(s.start, s.end) for s in row["base"]]
        for _, order, a, b in sorted(proposed.get(row.doc_id, [])):
            if not any(overlap((a, b), x) for x in bare) and not any(overlap((a, b), x[:2]) for x in taken):
                taken.append((a, b, names[order]))
        assert sorted((s.start, s.end, s.kind) for s in row["all"] if s.kind not in P.BASE) == sorted(taken)
        some += len(taken)
    assert some > 150


def test_a_chain_of_overlaps(spark):
    schema = "p array<struct<p:double,order:int,start:int,end:int>>, base array<struct<start:int,order:int,kind:string,end:int>>"
    chain = [(0.9, 0, 0, 10), (0.8, 1, 8, 20), (0.7, 2, 18, 30), (0.6, 3, 28, 40), (0.9, 4, 50, 60), (0.9, 0, 55, 60), (0.99, 0, 305, 310), (0.8, 1, 405, 410)]
    rows = [(chain, []), (chain, [(0, 2, "card", 1), (100, 0, "email", 400)]), ([], [(3, 0, "email", 9)])]
    got = [[(s.start, s.end) for s in r.x] for r in spark.createDataFrame(rows, schema).select(P._chosen(F.col("p"), F.col("base")).alias("x")).collect()]
    assert sorted(got[0]) == [(0, 10), (18, 30), (55, 60), (305, 310), (405, 410)]
    assert sorted(got[1]) == [(8, 20), (28, 40), (55, 60), (405, 410)] and got[2] == []


def test_redaction_and_empty(spark):
    df = spark.createDataFrame([(1, "mail a@b.cd or +1 555 010 1234, é"), (1, None), (None, "x")], "doc_id bigint, text string")
    rows = P.spans(df).select("doc_id", P.redacted(F.col("text"), F.col("all")).alias("t")).collect()
    assert sorted((str(r.doc_id), r.t) for r in rows) == [("1", ""), ("1", "mail [EMAIL] or [PHONE], é"), ("None", "x")]
    assert P.spans(df.limit(0)).count() == 0
    many = " ".join(f"a{i}@b.cd, +1 555 010 {1000 + i}" for i in range(700))
    text = spark.createDataFrame([(1, many)], "doc_id bigint, text string")
    got = P.spans(text).select(P.redacted(F.col("text"), F.col("all")).alias("t")).first().t
    assert got == re.sub(r"\+1 555 010 [0-9]+", "[PHONE]", re.sub(r"a[0-9]+@b\.cd", "[EMAIL]", many))
    spans = [(0, 0, "email", 5), (2, 1, "ip", 8), (3, 2, "card", 4), (8, 3, "phone", 9)]
    schema = "s array<struct<start:int,order:int,kind:string,end:int>>"
    assert spark.createDataFrame([(spans,)], schema).select(P.redacted(F.lit("0123456789é"), F.col("s")).alias("t")).first().t == "[EMAIL][PHONE]9é"


def test_many_matches(spark):
    text = "a1@b.cd " * 2000
    r = spark.createDataFrame([(text,)], "t string").select(N.found(F.col("t"), P.EMAIL).alias("s")).first().s
    assert [(x.start, x.end) for x in r] == [(8 * i, 8 * i + 7) for i in range(2000)]
