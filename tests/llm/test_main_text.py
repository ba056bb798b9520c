import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessella.llm.html_blocks import CHROME, LIKELY, MAIN, OPEN, blocks
from tessella.llm.main_text import extracted


def test_blocks():
    html = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <nav><ul><li><a href=x>Home</a></li></ul></nav><!-- ad --><div class="ad">Buy</div><div class="shadow">Open &amp; <b>bold</b>text</div>
    <article><header><h1>Head&eacute;</h1></header><p><b>One.<br><p>two&nbsp;
    three</p>tail<aside>side</aside><form><p>name</p></form><ul><li>a<li>b</ul></article>
    <div id="comments"><p>first!</p></div><footer>&copy; x</footer><p hidden>no</p>"""
    assert blocks(html) == [
        ("Home", CHROME), ("Buy", CHROME), ("Open & boldtext", OPEN), ("Headé", MAIN), ("One.", MAIN), ("two three", MAIN), ("tail", MAIN), ("side", CHROME), ("a", MAIN), ("b", MAIN), ("first!", CHROME), ("© x", CHROME),
    ]
    assert blocks(None) == blocks("") == blocks("<p> </p>") == []
    assert blocks("plain & text") == [("plain & text", OPEN)]
    assert blocks("<p>cut <b>off") == [("cut off", OPEN)]


COMMON = "all rights reserved by the owner of this site in the year"


def page(k, words=30):
    own = " ".join(f"w{k}x{i}" for i in range(words))
    return f"<body><div>{COMMON} {k}</div><p>{own}</p><p>short {k}</p><div>{COMMON}</div></body>", f"{own}\nshort {k}"


@pytest.mark.parametrize("shard", [4 << 20, 700])
def test_host_boilerplate(spark, shard):
    rows = [(k, f"https://a.example/{k}", page(k)[0]) for k in range(12)]
    rows += [(50, "https://b.example/1", page(50)[0]), (60, None, None), (61, "x", ""), (None, "https://a.example/z", f"<article><p>{COMMON}</p></article>"), (70, "https://c.example/", "<article>a</article>"), (70, "https://c.example/", "<article>a</article>")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", F.lit(1)).repartition(3)
    got = extracted(df, shard_bytes=shard).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r for r in got}
    for k in range(12):
        assert text[k].text == page(k)[1] and text[k].n_shared_words == 0 and text[k].n_chars == len(page(k)[1])
    assert text[50].text == f"{COMMON} 50\n{page(50)[1]}\n{COMMON}"  # the only page of its host
    assert text[60].text == "" == text[61].text and text[60].n_chars == 0
    assert text[None].text == COMMON and text[None].unique_text == "" and text[None].n_shared_words == 12
    assert text[70].text == "a"


def test_empty(spark):
    assert extracted(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


WIDTH = 6


def brute(rows):
    """The rules, page by page: text, and the number of blocks left out for their common runs."""
    pages = [(i, (re.search("//([^/]+)", u or "") or ["", ""])[1], blocks(h)) for i, u, h in rows]
    words = [[(w, k) for k, (t, _) in enumerate(b) for w in t.split()] for _, _, b in pages]

    def longest(b):
        own = [t for t, p in b if p != CHROME] or [t for t, _ in b]
        return max(own, key=lambda t: len(t.encode()), default=None)

    holders, texts = {}, {}
    for (_, host, b), w in zip(pages, words):
        texts.setdefault(host, set()).add(longest(b))
        for j in range(len(w) - WIDTH + 1):
            run = (host, *(x for x, _ in w[j : j + WIDTH]))
            holders.setdefault(run, set()).add(longest(b))
    out = []
    for (i, host, b), w in zip(pages, words):
        common = set()
        for j in range(len(w) - WIDTH + 1):
            run = (host, *(x for x, _ in w[j : j + WIDTH]))
            if len(holders[run]) >= min(3, max(2, len(texts[host]))):
                common |= set(range(j, j + WIDTH))
        order = [CHROME, OPEN, LIKELY, MAIN]
        best, kept, gone = max([OPEN, *(p for _, p in b)], key=order.index), [], 0
        for k, (t, p) in enumerate(b):
            own = [j for j, (_, x) in enumerate(w) if x == k]
            if p == best:
                drop = p != MAIN and (set(own) <= common if p == LIKELY else 100 * len(common & set(own)) >= 50 * len(own))
                gone += drop
                kept += [] if drop else [t]
        out.append((i, "\n".join(kept), gone))
    return out


def site(host, n, seed, marks):
    """(rows, article of each): pages of one template around their own articles, which an element, a name or nothing marks. Page 1 quotes page 0, pages 2 and 3 are nearly equal, page 4 comes twice."""
    r = np.random.default_rng(seed)
    sentence = lambda k: " ".join(f"{host[:2]}{x}" for x in r.integers(0, 5000, k))
    nav, notice, letter, foot = ("<li>".join(["", *(f"{host} {x}" for x in ("home", "news", "about us", "contact", "help", "jobs"))]), sentence(14), sentence(11), sentence(9))
    articles = [[sentence(int(r.integers(8, 60))) for _ in range(int(r.integers(2, 5)))] for _ in range(n)]
    articles[1][0] = articles[0][0] + " " + sentence(3)
    articles[3] = [*articles[2], sentence(8)]
    articles[2].append(max(articles[2], key=len) + " " + sentence(30))
    articles[3].append(articles[2][-1])
    rows = []
    for k, a in enumerate(articles):
        body = "".join(f"<p>{x}</p>" for x in a[:1]) + f"<p>{letter}</p>" + "".join(f"<p>{x}</p>" for x in a[1:])
        start, end = {"element": ("<article>", "</article>"), "name": ("<div class='post-body'>", "</div>"), "nothing": ("<div>", "</div>")}[marks]
        rows.append((k, f"https://{host}/{k}", f"<div><ul>{nav}</ul></div><div>{notice}</div>{start}{body}{end}<div>{foot}</div>"))
    return rows + [rows[4]], articles + [articles[4]]


@pytest.mark.parametrize("marks", ["element", "name", "nothing"])
@pytest.mark.parametrize("shard", [4 << 20, 3000])
def test_shared_runs_decide(spark, marks, shard):
    rows, articles = [], []
    for k, host in enumerate(["aa.example", "bb.example", "cc.example"]):
        got = site(host, 12, k, marks)
        rows += [(100 * k + i, u, h) for i, u, h in got[0]]
        articles += got[1]
    rows += [(900, "https://dd.example/1", site("dd.example", 6, 9, marks)[0][0][2])] * 3  # copies alone on their host
    got = extracted(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4), shard_bytes=shard).collect()
    assert sorted((r.page_id, r.text, r.n_common_blocks) for r in got) == sorted(brute(rows))
    text = {r.page_id: r.text for r in got}
    right = found = wanted = 0
    for (i, _, _), a in zip(rows, articles):
        kept = text[i].split("\n")
        right, found, wanted = right + len(set(kept) & set(a)), found + len(kept), wanted + len(a)
    # The letter in every article and, where nothing is marked, the template around it are found by shared runs alone.
    changed = sum(r.n_common_blocks > 0 for r in got)
    if marks == "element":
        assert changed == 0 and right == wanted and found == wanted + len(articles)
    else:
        assert changed >= 36 and right / found > 0.97 and right / wanted > 0.99
    assert text[900].count("\n") > 2
