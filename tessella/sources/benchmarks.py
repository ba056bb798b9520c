"""Question sets over long conversations, from nested JSON into rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INSTANCE = (
    "question_id string, question_type string, question string, answer string, question_date string, haystack_dates array<string>, haystack_session_ids array<string>, "
    "haystack_sessions array<array<struct<role:string,content:string,has_answer:boolean>>>, answer_session_ids array<string>"
)


def instances(spark: SparkSession, path: str) -> DataFrame:
    """One row for each question of a JSON array; a malformed file or a repeated id fails."""
    df = spark.read.schema(INSTANCE).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    twice = df.groupBy("question_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"question {twice[0].question_id} comes twice")
    return df


def turns(questions: DataFrame) -> DataFrame:
    """question_id, session_id, session_date, turn, role, content, has_answer."""
    each = questions.select("question_id", F.posexplode("haystack_sessions").alias("s", "session"), "haystack_session_ids", "haystack_dates")
    at = lambda a: F.try_element_at(a, F.col("s") + 1)
    flat = each.select("question_id", at("haystack_session_ids").alias("session_id"), at("haystack_dates").alias("session_date"), F.posexplode("session").alias("turn", "t"))
    return flat.select("question_id", "session_id", "session_date", "turn", "t.role", "t.content", F.coalesce("t.has_answer", F.lit(False)).alias("has_answer"))


def answered(questions: DataFrame) -> DataFrame:
    """Questions that have an answer: those that ask for abstention are left out."""
    return questions.where(~F.endswith("question_id", F.lit("_abs")))


def gold_sessions(questions: DataFrame) -> DataFrame:
    return questions.select("question_id", F.explode("answer_session_ids").alias("session_id")).distinct()


def evidence(questions: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(evidence that names a turn, evidence that doesn't): questions (question_id, evidence array of strings), known (turn_id). Several ids in one string are parted."""
    ids = questions.select("question_id", F.explode("evidence").alias("e")).select("question_id", F.explode(F.regexp_extract_all("e", F.lit(r"D\d+:\d+"), F.lit(0))).alias("turn_id")).distinct()
    return ids.join(known, "turn_id", "left_semi"), ids.join(known, "turn_id", "left_anti")
