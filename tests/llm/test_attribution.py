import numpy as np
import public_tokenizers as P
import pytest
from tessella.llm import attribution as A

PATH = P.path("byte_bpe_50k.tiktoken")
TEXTS = [None, "", "a b", "a\n\nb c\nd", "\n\nx", "x\n", "é\n日本\n\n\nz <|endoftext|>", "one. \n two", "word " * 3000 + "\nend", " \n \n "]


def brute(text, rule):
    text = text or ""
    encoding, _ = A.ranks(PATH)
    raw = text.encode()
    cuts = [0] + [i for i in range(1, len(raw)) if raw[i - 1 : i] == b"\n" and raw[i : i + 1] != b"\n"] + [len(raw)]
    out = [[len(raw[:a].decode()), len(raw[:b].decode()), 0.0, 0] for a, b in zip(cuts, cuts[1:])]
    at = 0
    for t in encoding.encode_ordinary(text):
        end = at + len(encoding.decode_single_token_bytes(t))
        parts = [max(0, min(end, b) - max(at, a)) for a, b in zip(cuts, cuts[1:])]
        first = next(i for i, p in enumerate(parts) if p)
        out[first][3] += sum(p > 0 for p in parts) > 1
        if rule == "proportional":
            for i, p in enumerate(parts):
                out[i][2] += p / (end - at)
        else:
            out[first if rule == "first" else parts.index(max(parts))][2] += 1
        at = end
    return out


@pytest.mark.parametrize("rule", A.RULES)
def test_against_brute_force(spark, rule):
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(TEXTS)] + [(None, "a", 1), (2, "a b", 1)], "doc_id bigint, text string, sections int").repartition(3)
    rows = A.counted(df, PATH, rule).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        if r.doc_id is not None:
            got = [[s.start, s.end, s.n_tokens, s.n_crossing] for s in r.sections]
            assert np.allclose(got, brute(TEXTS[r.doc_id], rule)), TEXTS[r.doc_id]


def test_intervals_random():
    r = np.random.default_rng(0)
    for _ in range(200):
        n = int(r.integers(1, 40))
        tokens = np.unique(np.concatenate([[0, n], r.integers(0, n, 8)]))
        sections = np.sort(np.concatenate([[0, n], r.integers(0, n + 1, 4)]))
        for rule in A.RULES:
            counts, crossing = A.attribute(tokens, sections, rule)
            assert abs(counts.sum() - (len(tokens) - 1)) < 1e-9
            covers = [sum(min(b, y) > max(a, x) for x, y in zip(sections, sections[1:])) for a, b in zip(tokens, tokens[1:])]
            assert crossing.sum() == sum(c > 1 for c in covers)


def test_empty(spark):
    assert A.counted(spark.createDataFrame([], "doc_id bigint, text string"), PATH).count() == 0
    with pytest.raises(ValueError):
        A.counted(spark.createDataFrame([], "doc_id bigint, text string"), PATH, "last")
