"""Quality rules from tokeniser fertility.

For every text a public vocabulary gives characters per token, the share of byte-fallback tokens and the
entropy of its tokens. Bands of rejection come from all documents of a language (or of a script, where
the language is unknown) of about the same length, as short texts vary more: the middle half of each
measure, widened. Beside them stand the base counts of
words, symbols, repeated lines and repeated word windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm import columns as C
from tessella.llm.piece_codec import codec
from tessella.llm.scratch import stored

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[*b"#*$%&|<>"]] = True
#: Lead bytes of UTF-8 by script; what isn't named is "other".
SCRIPTS = ["Latin", "Greek", "Cyrillic", "Hebrew", "Arabic", "Indic", "CJK", "Hangul", "other"]
_script = np.full(256, 255, np.uint8)
_script[65:91] = _script[97:123] = _script[0xC3:0xCC] = 0
_script[[0xCE, 0xCF]] = 1
_script[0xD0:0xD4] = 2
_script[[0xD6, 0xD7]] = 3
_script[0xD8:0xDC] = 4
_script[0xE0] = 5
_script[0xE3:0xEA] = 6
_script[0xEA:0xEE] = 7
_script[0xEE:0xF5] = 8

#: Smallest text that the bands are made from or applied to, in tokens; documents that a language and length need for bands without those of other lengths.
LEAST_TOKENS = 60
LEAST_DOCUMENTS = 30
#: How many times the middle half's width a band reaches beyond it, and the least width taken, in thousandths.
REACH = 4
WIDTHS = {"chars_per_token": 40, "fallback_share": 12, "token_entropy": 8}

MEASURED = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_tokens bigint, chars_per_token bigint, fallback_share bigint, token_entropy bigint, script string"


def _measure(data: np.ndarray, offsets: np.ndarray, model_path: str) -> list[np.ndarray]:
    starts, ends, first = C.tokens(data, offsets, C.NOT_SPACE6)
    n, n_words = len(offsets) - 1, np.diff(first)
    ids = np.arange(n)
    count = lambda flags: C.per_owner(offsets, flags)
    lead = (data & 0xC0) != 0x80
    inside = C.NOT_SPACE6[data]
    salt = C.mix(ids.astype(np.uint64) + np.uint64(1))

    # Lines: from each text's start or a line feed to the next.
    feeds = np.flatnonzero(data == 10)
    begins = np.sort(np.concatenate([offsets[:-1], feeds + 1]))
    doc = np.searchsorted(offsets[1:], begins, "right")
    own_feeds = np.concatenate([offsets[1:], feeds])
    stops = np.sort(own_feeds)
    if len(begins):
        # A line feed that ends a text begins an empty line there: the two sorted lists pair up text by text.
        doc = np.repeat(ids, 1 + count(data == 10))
        words = np.searchsorted(starts, stops) - np.searchsorted(starts, begins)
        kept = words > 0
        lines = C.range_hash(data, begins[kept], stops[kept]) ^ salt[doc[kept]]
        doc = doc[kept]
        distinct = np.unique(lines, return_index=True)[1]
        dup_lines = np.bincount(doc, minlength=n) - np.bincount(doc[distinct], minlength=n)
    else:
        dup_lines = np.zeros(n, np.int64)

    words = C.range_hash(data, starts, ends)
    own, nth = C.expand(np.maximum(n_words - 2, 0))
    at = first[own] + nth
    keys = C.window_hash(words, at, np.full(len(at), 3)) ^ salt[own]
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    again = at[counts[inverse] > 1]
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[again + k] = True

    c = codec(model_path)
    tokens, token_first, _, _ = c.encode(data, offsets)
    n_tokens = np.diff(token_first)
    plain_bytes = np.isin(tokens, [c.raw.piece_to_id(f"<0x{b:02X}>") for b in (9, 10, 13)])
    fallback = C.per_owner(token_first, c.is_byte[tokens] & ~plain_bytes)
    pairs = np.sort(np.repeat(ids, n_tokens) << 32 | tokens)
    edge = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.zeros(0, np.int64)
    runs = np.diff(np.append(edge, len(pairs)))
    spread = np.bincount(pairs[edge] >> 32, runs * np.log2(np.maximum(runs, 1)), n)
    some = np.maximum(n_tokens, 2)
    entropy = np.where(n_tokens > 1, (np.log2(some) - spread / some) / np.log2(some), 0.0)  # 1: no token twice

    kinds = np.stack([count(_script[data] == k) for k in range(len(SCRIPTS))])
    script = np.where(kinds.sum(0) > 0, kinds.argmax(0), len(SCRIPTS) - 1)
    chars = count(lead)
    return [
        n_words, count(lead & inside), count(SYMBOLS[data]), dup_lines, C.per_owner(first, covered), n_tokens,
        1000 * chars // np.maximum(n_tokens, 1), 1000 * fallback // np.maximum(n_tokens, 1), np.floor(1000 * np.maximum(entropy, 0)).astype(np.int64), script,
    ]


def measured(df: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text", lang_column: str | None = "lang") -> DataFrame:
    """The measures of every row of df: id, lang (null without a column for it) and the columns of MEASURED.

    Characters per token, fallback share (line feeds, tabs and returns apart) and entropy (of the most that
    so many tokens could have) are in thousandths, rounded down. A null or empty text has zeros.
    """
    lang = F.col(lang_column).cast("string") if lang_column else F.lit(None).cast("string")
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.pieces(batches, "text"):
            out = _measure(*C.text_bytes(batch.column("text")), model_path)
            script = pa.array([SCRIPTS[k] for k in out.pop().tolist()], pa.string())
            names = ["id", "lang", *(x.split()[0] for x in MEASURED.split(", "))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("lang"), *(pa.array(x.astype(np.int64)) for x in out), script], names)
        codec(model_path).release()

    got = df.select(F.col(id_column).alias("id"), lang.alias("lang"), F.col(text_column).alias("text")).mapInArrow(run, f"id {kind}, lang string, {MEASURED}")
    return got.withColumnRenamed("id", id_column)


def failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def bands(rows: DataFrame) -> DataFrame:
    """grp, measure, low, high from all measured rows that pass the base rules. grp is kind (language or script) and length (power of two of the tokens).

    A length of fewer than LEAST_DOCUMENTS takes in the nearest lengths of its kind until they have as many,
    all of them at the most; never another kind. Values are counted before they are shuffled: a window sorts
    the distinct values of a kind only, of which there are some thousands at most.
    """
    names = list(WIDTHS)
    measure = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in names))).alias("m")
    asked = rows.where(F.col("n_tokens") >= LEAST_TOKENS)
    fit = asked.where(~F.col("base_failed")).withColumnRenamed("length", "from")
    sizes = fit.groupBy("kind", "from").agg(F.count("*").alias("n"))
    pairs = asked.select("kind", "length", "grp").distinct().join(sizes, "kind").withColumn("far", F.abs(F.col("length") - F.col("from")))
    w = Window.partitionBy("grp")
    # The window's frame has all lengths of one distance, so what is left are those nearer.
    nearer = F.sum("n").over(w.orderBy("far")) - F.sum("n").over(Window.partitionBy("grp", "far"))
    used = pairs.withColumn("nearer", nearer).where(F.col("nearer") < LEAST_DOCUMENTS).select("kind", "from", "grp")
    counts = fit.groupBy("kind", "from", *names).count().select("kind", "from", measure, "count").groupBy("kind", "from", "m.measure", "m.value").agg(F.sum("count").alias("c"))
    counts = counts.join(used, ["kind", "from"]).groupBy("grp", "measure", "value").agg(F.sum("c").alias("c"))
    w = Window.partitionBy("grp", "measure")
    ranked = counts.withColumn("upto", F.sum("c").over(w.orderBy("value"))).withColumn("all", F.sum("c").over(w))
    at = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("all") * q, F.col("value")))
    quarters = ranked.groupBy("grp", "measure").agg(at(1).alias("q1"), at(3).alias("q3"))
    least = F.coalesce(*(F.when(F.col("measure") == m, F.lit(x)) for m, x in WIDTHS.items()))
    width = REACH * F.greatest(F.col("q3") - F.col("q1"), least)
    return quarters.select("grp", "measure", (F.col("q1") - width).alias("low"), (F.col("q3") + width).alias("high"))


#: Bands of so many groups are sent to every task; more are joined by key.
BROADCAST_GROUPS = 20_000


def judged(df: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text", lang_column: str | None = "lang") -> DataFrame:
    """measured(df) with base_failed, `reasons` (measures outside the bands, in order) and kept.

    A text of fewer than LEAST_TOKENS tokens is judged by the base rules only. A null language falls back on
    the script. Every other text is judged by bands of its language (else script), at any size of the
    corpus: a rare length by those of the nearest lengths too, see `bands`. Equal rows each get a row;
    statistics are over all rows.
    """
    rows = measured(df, model_path, id_column, text_column, lang_column)
    rows = rows.withColumn("base_failed", failed(F.col("n_words"), F.col("n_repeat_words"))).withColumn("kind", F.coalesce("lang", F.concat(F.lit("script "), F.col("script")))).withColumn("length", F.floor(F.log2(F.greatest("n_tokens", F.lit(1)))))
    rows = rows.withColumn("grp", F.concat_ws(" ", "kind", "length"))
    rows = stored(rows, "measured")
    limits = stored(bands(rows), "bands")
    wide = limits.groupBy("grp").agg(F.map_from_entries(F.collect_list(F.struct("measure", F.struct("low", "high")))).alias("b"))
    known = limits.select("grp").distinct().count() <= BROADCAST_GROUPS
    sent = F.broadcast(wide) if known else wide
    out = rows.join(sent, "grp", "left")

    def outside(m: str) -> Column:
        low, high = (F.col("b")[m][side] for side in ("low", "high"))
        return F.when((F.col("n_tokens") >= LEAST_TOKENS) & ((F.col(m) < low) | (F.col(m) > high)), F.lit(m))

    # A kind without any band has no text that passes the base rules.
    reasons = F.filter(F.array(*map(outside, WIDTHS)), lambda x: x.isNotNull())
    out = out.withColumn("reasons", reasons).withColumn("kept", ~F.col("base_failed") & (F.size("reasons") == 0))
    return out.drop("b", "kind", "length")
