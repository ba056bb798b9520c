"""Ranked retrieval: weighted BM25 over four columns, best block of a turn, newest generation, total order, top k.

The index is two tables: postings (row, column, term, positions) and lengths. Statistics count every block
of every generation, empty ones too; duplicates are resolved after scoring. What a query sends to tasks
are its terms and two numbers for each (at most TERMS), whatever the corpus' size.
"""

from __future__ import annotations

import importlib
import math
import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as T

COLUMNS = ("prose", "tool_use", "tool_result", "paths")
WEIGHTS = {"prose": 4.0, "tool_use": 2.0, "tool_result": 1.0, "paths": 3.0}
TERMS = 64
K1, B, FLOOR = 1.2, 0.75, 1e-6


def query_terms(query: str) -> tuple[list[list[str]], int]:
    """(phrases, terms dropped): each word-like part of the query is a phrase of one or more tokens; repeats count again."""
    found = re.findall(r"\w+", unicodedata.normalize("NFC", query))
    return [re.findall(r"[^\W_]+", T.fold_plain(t)) for t in found[:TERMS]], max(0, len(found) - TERMS)


def lengths(blocks: DataFrame) -> DataFrame:
    """row_id, dl: tokens over all columns."""
    return blocks.select("row_id", sum((F.size(T.tokenize(F.col(c))) for c in COLUMNS), F.lit(0)).cast("bigint").alias("dl"))


def postings(blocks: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """row_id, dl, field, term, positions (from 0). With terms only theirs are made: tokens of others never leave the row."""
    rows = blocks.select("row_id", *(T.tokenize(F.col(c)).alias(c) for c in COLUMNS))
    rows = rows.withColumn("dl", sum((F.size(c) for c in COLUMNS), F.lit(0)).cast("bigint"))
    placed = lambda c: F.transform(F.col(c), lambda t, i: F.struct(F.lit(c).alias("field"), t.alias("term"), i.alias("at")))
    every = F.concat(*(placed(c) for c in COLUMNS))
    if terms is not None:
        every = F.filter(every, lambda p: p["term"].isin(terms or [""]))
    return rows.select("row_id", "dl", F.explode(every).alias("p")).groupBy("row_id", "dl", F.col("p.field").alias("field"), F.col("p.term").alias("term")).agg(F.array_sort(F.collect_list("p.at")).alias("positions"))


def corpus(blocks: DataFrame) -> tuple[int, int]:
    """(rows, tokens)."""
    row = lengths(blocks).agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    return row[0], row[1]


def phrase_hits(index: DataFrame, phrases: list[list[str]]) -> DataFrame:
    """row_id, dl, ordinal, field, tf: occurrences of each phrase, tokens next to each other in one column."""
    wanted = [(i, k, t) for i, p in enumerate(phrases) for k, t in enumerate(p)]
    spark = index.sparkSession
    terms = spark.createDataFrame(wanted, "ordinal int, k int, term string")
    sizes = F.create_map(*(F.lit(x) for i, p in enumerate(phrases) for x in (i, len(p)))) if phrases else F.lit(None)
    hits = index.join(F.broadcast(terms), "term").select("row_id", "dl", "ordinal", "field", F.explode(F.transform("positions", lambda x: x - F.col("k"))).alias("start"))
    # A phrase starts where all its tokens, set back by their place, meet.
    whole = hits.groupBy("row_id", "dl", "ordinal", "field", "start").count().where(F.col("count") == F.element_at(sizes, F.col("ordinal")))
    return whole.groupBy("row_id", "dl", "ordinal", "field").agg(F.count("*").alias("tf"))


def scores(blocks: DataFrame, query: str, weights: dict[str, float] = WEIGHTS, index: DataFrame | None = None, totals: tuple[int, int] | None = None) -> DataFrame:
    """row_id, score (negated: the best is the smallest) of every row with a term of the query. index and totals may be stored ones of the same blocks."""
    phrases = [p for p in query_terms(query)[0] if p]
    spark = blocks.sparkSession
    if not phrases:
        return spark.createDataFrame([], "row_id bigint, score double")
    index = postings(blocks, sorted({t for p in phrases for t in p})) if index is None else index.where(F.col("term").isin(sorted({t for p in phrases for t in p})))
    rows, tokens = totals or corpus(blocks)
    weight = F.element_at(F.create_map(*(F.lit(x) for c in COLUMNS for x in (c, float(weights[c])))), F.col("field"))
    tf = phrase_hits(index, phrases).groupBy("row_id", "dl", "ordinal").agg(F.sum(weight * F.col("tf")).alias("f"))
    seen = {r.ordinal: r.n for r in tf.groupBy("ordinal").agg(F.count("*").alias("n")).collect()}
    idf = {i: max(FLOOR, math.log((rows - n + 0.5) / (n + 0.5))) if rows - n + 0.5 > 0 else FLOOR for i, n in seen.items()}
    if not idf:
        return spark.createDataFrame([], "row_id bigint, score double")
    idf = {i: FLOOR if v <= 0 else v for i, v in idf.items()}
    rarity = F.element_at(F.create_map(*(F.lit(x) for i, v in idf.items() for x in (i, v))), F.col("ordinal"))
    f = F.col("f")
    term = rarity * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / (tokens / rows)))
    return tf.groupBy("row_id").agg((-F.sum(term)).alias("score"))


def best_blocks(scored: DataFrame) -> DataFrame:
    """The best block of each turn; of a turn that several generations carry, the newest."""
    w = Window.partitionBy("turn_id", "agent", "session_id").orderBy("score", F.desc("generation"), "block_seq", "row_id")
    return scored.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


#: What ranks a hit. Texts are fetched for the best k only.
SLIM = ("row_id", "turn_id", "agent", "session_id", "generation", "block_seq", "session_key", "byte_offset")
ORDER = ("score", "session_key", "byte_offset", "block_seq")


def search(blocks: DataFrame, query: str, k: int = 10, weights: dict[str, float] = WEIGHTS, index: DataFrame | None = None, totals: tuple[int, int] | None = None) -> DataFrame:
    """The k best turns in a total order, with `rank` from 1.

    With a stored index and totals no text is read but that of k rows: hits are ranked by the columns of SLIM,
    and the best are read by their row ids, which a table sorted by them finds by its statistics.
    """
    hits = best_blocks(scores(blocks, query, weights, index, totals).join(blocks.select(*SLIM), "row_id"))
    top = hits.orderBy(*ORDER).limit(max(k, 0)).select("row_id", "score").collect()
    rows = blocks.where(F.col("row_id").isin([r.row_id for r in top]) if top else F.lit(False))
    score = F.element_at(F.create_map(*(F.lit(x) for r in top for x in (r.row_id, r.score))), F.col("row_id")) if top else F.lit(0.0)
    # At most k rows are ranked.
    return rows.withColumn("score", score).withColumn("rank", F.row_number().over(Window.orderBy(*ORDER)).cast("bigint"))


def retriever(blocks: DataFrame, index: DataFrame | None = None, totals: tuple[int, int] | None = None, weights: dict[str, float] = WEIGHTS) -> Callable[[str, int], list[int]]:
    """A function from a question and k to the byte offsets of the best turns, best first."""

    def ask(query: str, k: int = 10) -> list[int]:
        return [r.byte_offset for r in search(blocks, query, k, weights, index, totals).select("byte_offset", "rank").orderBy("rank").collect()]

    return ask


def latest(hits: DataFrame) -> DataFrame:
    return _reranked(hits, T.utc(F.col("ts")).desc_nulls_last())


def latest_user(hits: DataFrame) -> DataFrame:
    """What users typed, newest first, then the rest. What a machine wrote into a user's turn isn't typed."""
    from tessella.operators.derive import injected_column

    user = F.coalesce((F.col("role") == "user") & (F.col("kind") == "text"), F.lit(False))
    return _reranked(hits.withColumn("_typed", user & ~injected_column(F.col("prose"))), F.col("_typed").desc(), T.utc(F.col("ts")).desc_nulls_last()).drop("_typed")


def relevance(hits: DataFrame) -> DataFrame:
    return _reranked(hits)


def custom(name: str) -> Callable[[DataFrame], DataFrame]:
    """A policy that is named `module:function`: it takes the hits by rank and returns those it keeps with a column `order`."""
    module, _, function = name.partition(":")
    if not module or not function:
        raise ValueError(f"{name!r}: a policy is one of {', '.join(POLICIES)} or module:function")
    chosen = getattr(importlib.import_module(module), function)

    def policy(hits: DataFrame) -> DataFrame:
        kept = chosen(hits)
        return _reranked(kept, F.col("order").asc_nulls_last()).drop("order")

    return policy


def reorder(name: str) -> Callable[[DataFrame], DataFrame]:
    return POLICIES.get(name) or custom(name)


POLICIES = {"latest": latest, "latest-user": latest_user, "relevance": relevance}


def _reranked(hits: DataFrame, *order: Column) -> DataFrame:
    """hits are bounded by the search's k."""
    return hits.withColumn("place", F.row_number().over(Window.orderBy(*order, "rank")).cast("bigint"))


def recall(blocks: DataFrame, query: str, k: int = 10, policy: str = "latest-user") -> DataFrame:
    hits = reorder(policy)(search(blocks, query, k))
    return hits.select("place", "rank", "session_key", "byte_offset", T.utc_format(T.utc(F.col("ts")), "yyyy-MM-dd'T'HH:mm'Z'").alias("at"), T.recall_line(F.col("prose")).alias("line"))
