"""The evaluation harness: arms, metrics at two levels, gold by protocol, baselines and summaries, as plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("turn_recall", "turn_mrr", "session_recall", "session_mrr", "unmatched", "turn_hit", "turn_recall_all", "session_hit", "session_recall_all")


def arm_reference(gold: DataFrame, query: str, offset: str, k: int = 10) -> DataFrame:
    """The gold offsets themselves, ascending, as a ranking of at most k."""
    w = Window.partitionBy(query).orderBy(offset)
    return gold.select(query, offset).distinct().withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def arm_none(ranked: DataFrame) -> DataFrame:
    return ranked.limit(0)


def measured(ranked: DataFrame, gold: DataFrame, query: str) -> DataFrame:
    """METRICS for each query of gold.

    ranked: query, rank, turn, session (both null where an offset lies in no turn: it keeps its rank and is
    counted as unmatched). gold: query, level (`turn` or `session`), item. Distinct items found count; a query
    without gold of a level has zeros there.
    """
    items = ranked.select(query, "rank", F.explode(F.array(F.struct(F.lit("turn").alias("level"), F.col("turn").cast("string").alias("item")), F.struct(F.lit("session").alias("level"), F.col("session").cast("string").alias("item")))).alias("i"))
    items = items.select(query, "rank", "i.level", "i.item").where("item is not null")
    wanted = gold.select(query, "level", F.col("item").cast("string").alias("item")).where("item is not null").distinct()
    hits = items.join(wanted, [query, "level", "item"]).groupBy(query, "level").agg(F.count_distinct("item").alias("found"), F.min("rank").alias("first"))
    total = wanted.groupBy(query, "level").agg(F.count("*").alias("relevant"))
    per = total.join(hits, [query, "level"], "left").na.fill(0, ["found"])
    at = lambda level, value: F.coalesce(F.max(F.when(F.col("level") == level, value)), F.lit(0.0))
    columns = []
    for level in ("turn", "session"):
        share = F.col("found") / F.col("relevant")
        columns += [at(level, share).alias(f"{level}_recall"), at(level, F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias(f"{level}_mrr"), at(level, (F.col("found") > 0).cast("double")).alias(f"{level}_hit"), at(level, (F.col("found") == F.col("relevant")).cast("double")).alias(f"{level}_recall_all")]
    lost = ranked.where("turn is null").groupBy(query).agg(F.count("*").alias("unmatched"))
    every = gold.select(query).distinct().join(per.groupBy(query).agg(*columns), query, "left").join(lost, query, "left")
    return every.select(query, *(F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias(m) for m in METRICS))


def metric_summary(measures: DataFrame, mode: str, kind: str, arm: str) -> DataFrame:
    """Means of METRICS for each mode and arm, and for each kind of question in it (kind `all`: all of them)."""
    means = measures.groupingSets([[mode, arm], [mode, kind, arm]], mode, kind, arm).agg(F.count("*").alias("n"), F.grouping(kind).alias("whole"), *(F.avg(m).alias(m) for m in METRICS))
    return means.withColumn(kind, F.when(F.col("whole") == 1, F.lit("all")).otherwise(F.col(kind))).drop("whole")


def gold_sessions(turns: DataFrame, protocol: str) -> DataFrame:
    """question, session: gold of a protocol from turns (question, session, answer_session, role, has_answer).

    `plain`: the sessions a question names. `evidence`: of those the ones in which a user's turn has the
    answer; questions that are to be declined (`_abs`) have none.
    """
    named = turns.where("answer_session")
    if protocol == "evidence":
        named = named.where("role = 'user' and has_answer").where(~F.endswith("question", F.lit("_abs")))
    return named.select("question", "session").distinct()


def after_failure(blocks: DataFrame, session: str = "session_id") -> DataFrame:
    """Blocks of the first assistant turn after a turn with a failed tool result: blocks (session, seq, block_seq, role, kind, failed, …) as they are, with failed_at.

    Each turn looks ahead for the next assistant turn by one window over turns; nothing is paired.
    """
    turns = blocks.groupBy(session, "seq", "role").agg(F.max(F.coalesce(F.col("failed") & (F.col("kind") == "tool_result"), F.lit(False))).alias("bad"))
    ahead = Window.partitionBy(session).orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    due = turns.withColumn("next", F.min(F.when(F.col("role") == "assistant", F.col("seq"))).over(ahead))
    due = due.where("bad and role = 'user' and next is not null").groupBy(session, F.col("next").alias("seq")).agg(F.max("seq").alias("failed_at"))
    return blocks.join(due, [session, "seq"])


def baseline_naive(blocks: DataFrame, session: str = "session_id") -> DataFrame:
    """A reversal at the first block of each assistant turn that follows a failed tool result."""
    w = Window.partitionBy(session, "seq").orderBy("block_seq")
    return after_failure(blocks, session).withColumn("rn", F.row_number().over(w)).where("rn = 1").select(session, F.lit("reversal").alias("decision"), "block_id")


def baseline_leak(blocks: DataFrame, session: str = "session_id") -> DataFrame:
    """A reversal at the first block of an assistant turn whose command differs from that two turns before, with a user's failed tool result between."""
    first = lambda c, test: F.min_by(c, F.when(test, F.col("block_seq")))
    turns = blocks.groupBy(session, "seq").agg(F.first("role").alias("role"), F.max(F.coalesce(F.col("failed") & (F.col("kind") == "tool_result"), F.lit(False))).alias("bad"), first("prose", F.col("kind") == "tool_use").alias("command"), F.min_by("block_id", "block_seq").alias("block_id"))
    w = Window.partitionBy(session).orderBy("seq")
    back = lambda c, n: F.lag(c, n).over(w)
    rows = turns.select(session, "role", "command", "block_id", back("role", 1).alias("r1"), back("bad", 1).alias("b1"), back("role", 2).alias("r2"), back("command", 2).alias("c2"))
    return rows.where("role = 'assistant' and r1 = 'user' and b1 and r2 = 'assistant' and command <> c2").select(session, F.lit("reversal").alias("decision"), "block_id")


def baseline_nothing(blocks: DataFrame, session: str = "session_id") -> DataFrame:
    return baseline_naive(blocks, session).limit(0)


def probe_score(cases: DataFrame) -> DataFrame:
    """class_ok, class_n, aside_ok, aside_n over cases (aside, expected, got); null is a label like any other."""
    right = F.col("expected").eqNullSafe(F.col("got")).cast("bigint")
    n = lambda value, test: F.coalesce(F.sum(F.when(test, value)), F.lit(0)).cast("bigint")
    return cases.agg(n(right, ~F.col("aside")).alias("class_ok"), n(F.lit(1), ~F.col("aside")).alias("class_n"), n(right, F.col("aside")).alias("aside_ok"), n(F.lit(1), F.col("aside")).alias("aside_n"))


def census_score(cases: DataFrame, label: str = "directive") -> DataFrame:
    """tp, fp, fn, machine_fp, aside_n, aside_labelled, precision and recall (1 on nothing) of a label over cases (aside, machine, want, got)."""
    n = lambda test: F.count(F.when(test, 1))
    own, got, want = ~F.col("aside"), F.col("got").eqNullSafe(F.lit(label)), F.col("want").eqNullSafe(F.lit(label))
    counts = cases.agg(n(own & got & want).alias("tp"), n(own & got & ~want).alias("fp"), n(own & want & ~got).alias("fn"), n(own & got & ~want & F.col("machine")).alias("machine_fp"), n(F.col("aside")).alias("aside_n"), n(F.col("aside") & F.col("got").isNotNull()).alias("aside_labelled"))
    share = lambda b: F.coalesce(F.try_divide("tp", F.col("tp") + F.col(b)), F.lit(1.0))
    return counts.withColumn("precision", share("fp")).withColumn("recall", share("fn"))


def qa_summary(records: DataFrame, kind: str, right: Column) -> DataFrame:
    """type (`all` for all), n, accuracy."""
    sums = records.withColumn("_right", right.cast("double")).groupingSets([[kind], []], kind).agg(F.grouping(kind).alias("whole"), F.count("*").alias("n"), F.avg("_right").alias("accuracy"))
    return sums.select(F.when(F.col("whole") == 1, F.lit("all")).otherwise(F.col(kind)).alias("type"), "n", "accuracy")


def locomo_summary(measures: DataFrame, metrics: list[str]) -> DataFrame:
    """Means of the metrics for each arm, k and category; category 0 is over all."""
    sums = measures.groupingSets([["arm", "k", "category"], ["arm", "k"]], "arm", "k", "category").agg(F.grouping("category").alias("whole"), F.count("*").alias("n"), *(F.avg(m).alias(m) for m in metrics))
    return sums.select("arm", "k", F.when(F.col("whole") == 1, F.lit(0).cast("bigint")).otherwise(F.col("category").cast("bigint")).alias("category"), "n", *metrics)


#: How a reader is shown sessions.
TURN, SESSION, DATE, CONTENT = "\n\n", "\n### Session ", ":\nSession Date: ", "\nSession Content:\n"


def qa_history(turns: DataFrame, question: str = "question") -> DataFrame:
    """question, history: its sessions by date (ties by rank), each with a heading and its turns in order. turns: question, session, date, rank, seq, role, content."""
    said = F.concat(F.lit(TURN), "role", F.lit(": "), F.regexp_replace("content", r"(?U)^\s+|\s+$", ""))
    rows = turns.select(question, "session", "date", "rank", F.struct("seq", said.alias("text")).alias("t"))
    bodies = rows.groupBy(question, "session", "date", "rank").agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["text"]), "").alias("body"))
    chunks = bodies.groupBy(question).agg(F.array_sort(F.collect_list(F.struct("date", "rank", "body"))).alias("c"))
    head = lambda c, i: F.concat(F.lit(SESSION), (i + 1).cast("string"), F.lit(DATE), c["date"], F.lit(CONTENT), c["body"], F.lit("\n"))
    return chunks.select(question, F.array_join(F.transform("c", head), "").alias("history"))
