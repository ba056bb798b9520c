"""Evaluation: as-of mapping, ranking metrics, fusion, precision and recall, significance."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(points: DataFrame, spans: DataFrame, key: str, point: str, start: str, length: str, value: str) -> DataFrame:
    """points with the value of the span of the same key that holds the point (null: none). Spans of a key do not overlap.

    Points and spans are put in one order, and the last start is carried on: no pair of rows meets.
    """
    names = points.columns
    left = points.select(F.struct(*names).alias("row"), F.col(key).alias("k"), F.col(point).cast("bigint").alias("at"), F.lit(1).alias("side"), F.lit(None).cast(f"struct<s:bigint,e:bigint,v:{spans.schema[value].dataType.simpleString()}>").alias("span"))
    right = spans.select(F.lit(None).cast(left.schema["row"].dataType).alias("row"), F.col(key).alias("k"), F.col(start).cast("bigint").alias("at"), F.lit(0).alias("side"), F.struct(F.col(start).cast("bigint").alias("s"), (F.col(start) + F.col(length)).cast("bigint").alias("e"), F.col(value).alias("v")).alias("span"))
    w = Window.partitionBy("k").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("span", F.last("span", ignorenulls=True).over(w)).where("side = 1")
    return both.select("row.*", F.when(F.col("span.e") > F.col("at"), F.col("span.v")).alias(value))


def fused(arms: list[DataFrame], query: str, item: str, depth: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of rankings (query, item, rank from 1), with `rank` by score and then item."""
    every = arms[0].select(query, item, "rank")
    for a in arms[1:]:
        every = every.unionByName(a.select(query, item, "rank"))
    got = every.groupBy(query, item).agg(F.sum(1.0 / (F.lit(float(depth)) + F.col("rank"))).alias("score"))
    w = Window.partitionBy(query).orderBy(F.desc(F.round("score", 12)), item)
    return got.withColumn("rank", F.row_number().over(w).cast("bigint"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda t, v: t + v)
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(1e-9))


#: Query vectors that are scored in one pass over all rows, and the cells of a matrix that a task has at a time, whatever a batch's rows.
QUERY_BLOCK, CELLS = 2048, 1 << 21


class Best:
    """The `depth` nearest items of each query so far; rows are added in pieces, so memory is that of CELLS and of the answers.

    Matrix products only tell what can't be among them; what may be is scored pair by pair, so scores don't depend on the pieces.
    """

    def __init__(self, names: np.ndarray, q: np.ndarray, depth: int, metric: str) -> None:
        self.names, self.q, self.depth, self.metric = names, q, depth, metric
        self.square = (q * q).sum(1)
        self.least, self.last = np.full(len(names), -np.inf), np.full(len(names), np.iinfo(np.int64).max)
        self.own, self.items, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, items: np.ndarray, e: np.ndarray) -> None:
        step = max(1, CELLS // len(self.names))
        for k in range(0, len(items), step):
            self._piece(items[k : k + step], e[k : k + step])

    def _piece(self, items: np.ndarray, e: np.ndarray) -> None:
        rough, square = self.q @ e.T, (e * e).sum(1)
        # Rounding to six digits moves a score by half of 1e-6, a product's error is far below 1e-12 of the squares.
        if self.metric == "cosine":
            rough /= np.maximum(np.sqrt(self.square)[:, None] * np.sqrt(square)[None, :], 1e-9)
            slack = 2e-6
        else:
            sums = self.square[:, None] + square[None, :]
            rough *= -2
            rough += sums
            sums *= 1e-12
            # The smallest distance that the error allows.
            rough -= sums
            rough = -np.sqrt(np.maximum(rough, 0))
            slack = 2e-6 + 2e-6 * np.sqrt(self.square + square[np.isfinite(square)].max(initial=0))
        rough[items[None, :] == self.names[:, None]] = -np.inf
        floor = self.least - slack
        near = rough >= floor[:, None]
        if len(items) > self.depth and np.count_nonzero(near) > self.depth * len(self.names):
            # A piece passes on no more than its own best ones, and what the error may have in their place.
            floor = np.fmax(floor, np.partition(np.nan_to_num(rough, nan=-np.inf), -self.depth, axis=1)[:, -self.depth] - slack)
            near = rough >= floor[:, None]
        near &= rough > -np.inf
        own, col = np.nonzero(near)
        del rough, near
        some = max(1, (CELLS >> 3) // max(1, e.shape[1]))
        scores = np.zeros(len(own))
        for k in range(0, len(own), some):
            scores[k : k + some] = self._exact(self.q[own[k : k + some]], e[col[k : k + some]])
        scores, items = np.round(scores, 6) + 0.0, items[col]
        keep = np.isfinite(scores) & ((scores > self.least[own]) | ((scores == self.least[own]) & (items < self.last[own])))
        if keep.any():
            self._merge(own[keep], items[keep], scores[keep])

    def _exact(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.metric == "cosine":
            return (a * b).sum(1) / np.maximum(np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)), 1e-9)
        return -np.sqrt(((b - a) ** 2).sum(1))

    def _merge(self, own: np.ndarray, items: np.ndarray, scores: np.ndarray) -> None:
        own, items, scores = np.concatenate([self.own, own]), np.concatenate([self.items, items]), np.concatenate([self.scores, scores])
        order = np.lexsort((items, -scores, own))
        own, items, scores = own[order], items[order], scores[order]
        place = np.arange(len(own)) - np.searchsorted(own, own)
        keep = place < self.depth
        full = place == self.depth - 1
        self.least[own[full]], self.last[own[full]] = scores[full], items[full]
        self.own, self.items, self.scores = own[keep], items[keep], scores[keep]


def nearest(vectors: DataFrame, asked: DataFrame, key: str, vector: str, depth: int, metric: str = "cosine", block: int = QUERY_BLOCK) -> DataFrame:
    """query, item, score (six digits) and rank up to depth: for each row of `asked` the nearest ones of `vectors`, itself left out; ties by item.

    Exact. The queries go in blocks of bounded size, each by one pass over the vectors; a task multiplies matrices of
    bounded size and passes on its best `depth` for each query only, so no pair of rows is shuffled. `cosine`, or
    `distance` (Euclidean, the smallest first). Rows without a vector neither ask nor answer.
    """
    spark, sign = vectors.sparkSession, 1.0 if metric == "cosine" else -1.0
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("item"), F.col(vector).cast("array<double>").alias("e"))
    queries = asked.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("query"), F.col(vector).cast("array<double>").alias("e"))
    n_blocks = -(-queries.count() // block)
    out = spark.createDataFrame([], "query bigint, item bigint, score double")

    def scorer(names: np.ndarray, q: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(names, q, depth, metric)
            for batch in batches:
                if batch.num_rows:
                    best.add(np.asarray(batch.column("item"), np.int64), np.asarray(batch.column("e").flatten(), float).reshape(batch.num_rows, -1))
            for k in range(0, len(best.own), CELLS):
                part = slice(k, k + CELLS)
                yield pa.RecordBatch.from_arrays([pa.array(names[best.own[part]]), pa.array(best.items[part]), pa.array(sign * best.scores[part])], ["query", "item", "score"])

        return run

    for k in range(n_blocks):
        part = queries.where(F.pmod(F.xxhash64("query"), F.lit(n_blocks)) == k).toPandas()
        if len(part):
            out = out.unionByName(rows.mapInArrow(scorer(part["query"].to_numpy(np.int64), np.stack(part["e"].map(np.asarray))), "query bigint, item bigint, score double"))
    w = Window.partitionBy("query").orderBy((F.col("score") * sign).desc(), "item")
    return out.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= depth)


def ranking_metrics(ranked: DataFrame, gold: DataFrame, query: str, item: str, k: int = 10, official: bool = False) -> DataFrame:
    """recall, hit, all_found, mrr and ndcg at k for each query with gold items. official: ranks 1 and 2 are discounted alike."""
    hits = ranked.where(F.col("rank") <= k).select(query, item, "rank").join(gold.select(query, item).distinct(), [query, item])
    discount = F.log2(F.greatest(F.col("rank"), F.lit(2))) if official else F.log2(F.col("rank") + 1)
    per = hits.groupBy(query).agg(F.count("*").alias("found"), F.min("rank").alias("first"), F.sum(1.0 / discount).alias("dcg"))
    total = gold.select(query, item).distinct().groupBy(query).agg(F.count("*").alias("relevant"))
    place = lambda i: F.log2(F.greatest(i, F.lit(2)).cast("double")) if official else F.log2((i + 1).cast("double"))
    ideal = F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.least(F.col("relevant"), F.lit(k).cast("bigint"))), F.lit(0.0), lambda t, i: t + 1.0 / place(i))
    found = F.coalesce("found", F.lit(0))
    return total.join(per, query, "left").select(
        query, "relevant", found.alias("found"), (found / F.col("relevant")).alias("recall"), F.when(found > 0, 1).otherwise(0).alias("hit"), F.when(found == F.col("relevant"), 1).otherwise(0).alias("all_found"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"), (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"),
    )


def matched(predicted: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """keys, predicted, gold, right: counts with multiplicity, each prediction matching one gold row at most."""
    p = predicted.groupBy(*keys).agg(F.count("*").alias("predicted"))
    g = gold.groupBy(*keys).agg(F.count("*").alias("gold"))
    both = p.join(g, keys, "full").na.fill(0, ["predicted", "gold"])
    return both.withColumn("right", F.least("predicted", "gold"))


def precision_recall(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    sums = counts.groupBy(*(by or [])).agg(F.sum("predicted").alias("predicted"), F.sum("gold").alias("gold"), F.sum("right").alias("right"))
    return sums.withColumn("precision", F.try_divide("right", "predicted")).withColumn("recall", F.try_divide("right", "gold"))


def deranged(questions: DataFrame, group: str, key: str, column: str) -> DataFrame:
    """Each row with another row's value of the same group, in the order of the keys' hashes; the last one gets the first.

    Groups of one make a group together; a single one of them joins the largest other group. So no row gets its
    own, unless it is the only row, which gets null.
    """
    sizes = questions.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_n"))
    # One row for each group: their number is that of the question types.
    most = sizes.agg(F.sum((F.col("_n") == 1).cast("int")).alias("_ones"), F.max(F.when(F.col("_n") > 1, F.struct("_n", F.col("_g").cast("string").alias("g"))))["g"].alias("_largest"))
    merged = sizes.join(F.broadcast(most)).select("_g", F.when(F.col("_n") > 1, F.col("_g").cast("string")).when(F.col("_ones") > 1, F.lit("\x00")).otherwise(F.coalesce("_largest", F.lit("\x00"))).alias("_set"))
    rows = questions.join(merged, questions[group].eqNullSafe(merged["_g"])).drop("_g")
    w = Window.partitionBy("_set").orderBy(F.sha2(F.col(key).cast("string"), 256), key)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    alone = F.count("*").over(Window.partitionBy("_set")) == 1
    following = F.lead(F.struct(column)).over(w)
    return rows.withColumn("other", F.when(~alone, F.coalesce(following, F.first(F.struct(column)).over(whole))[column])).drop("_set")


#: Pairs up to which the test goes through every sign.
EXACT = 14


def sign_flip(differences: list[float]) -> float:
    """One-sided chance, if signs were arbitrary, of a sum as large: exact for few pairs, else by the normal form; never 0. A list of a benchmark's few hundred summary rows."""
    d = [x for x in differences if x]
    if not d:
        return 1.0
    seen = sum(d)
    if len(d) <= EXACT:
        sums = (sum(s * abs(x) for s, x in zip(signs, d, strict=True)) for signs in itertools.product((1, -1), repeat=len(d)))
        return sum(s >= seen - 1e-12 for s in sums) / 2 ** len(d)
    z = seen / math.sqrt(sum(x * x for x in d))
    return max(0.5 * math.erfc(z / math.sqrt(2)), 5e-324)


def calibrated(summary: dict[str, float], pairs: int, p: float, tests: int = 1, least: int = 20, leak: float = 0.05, level: float = 0.05) -> dict[str, bool]:
    """Gates over mean scores of the arms reference, candidate, none and shuffled."""
    return {
        "sample": pairs >= least,
        "reference": summary["reference"] >= 1.0 - 1e-12,
        "signal": summary["candidate"] > summary["none"],
        "leakage": summary["shuffled"] - summary["none"] <= leak,
        "claim": p <= level / max(1, tests),
    }
