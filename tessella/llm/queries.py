"""The queries opN_<name> and their SQL. Each applies its operator, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.oracle import ORACLE_SQL  # noqa: F401  the driver's entry reads it here

PIECES = public_tokenizers.path("piece_bpe_32k.model")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.main_text import extracted

    return extracted(table(spark, sf_dir, "pages")).drop("unique_text")


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.decontaminate import contamination

    got = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.concat_ws(",", F.array_sort(F.transform("items", lambda x: x.cast("string")))), 256)
    # Items without an id are one item without a name.
    n_items = F.size("items").cast("bigint") + F.col("unnamed").cast("bigint")
    return got.select("doc_id", "n_words", "n_hit", n_items.alias("n_items"), items.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.attribution import counted

    got = counted(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), "first")
    total = lambda name: F.aggregate("sections", F.lit(0).cast("bigint"), lambda t, s: t + s[name].cast("bigint"))
    each = F.transform("sections", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"), s["n_tokens"].cast("bigint").cast("string")))
    return got.select("doc_id", total("n_tokens").alias("n_tokens"), total("n_crossing").alias("n_crossing"), F.size("sections").cast("bigint").alias("n_sections"), F.concat_ws(",", each).alias("section_tokens"))


@query
def op4_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.quality import judged

    got = judged(table(spark, sf_dir, "documents"), PIECES)
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_tokens", "chars_per_token", "fallback_share", "token_entropy")


@query
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.native import listed
    from tessella.llm.secrets import BASE, spans

    got = spans(table(spark, sf_dir, "documents"))
    counts = [F.size(k).cast("bigint").alias(f"n_{k}") for k in BASE]
    method = [F.size("tests").cast("bigint").alias("n_tested"), F.size("doubtful").cast("bigint").alias("n_doubtful")]
    return got.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("all")).alias("spans"), *method)


@query
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.repeated_bytes import deduplicated

    return deduplicated(table(spark, sf_dir, "documents")).drop("kept")


@query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.warc import archived, records

    return records(archived(table(spark, sf_dir, "pages")), payloads=False).drop("url", "payload")


@query
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.shingle_join import classes

    return classes(table(spark, sf_dir, "documents"))


@query
def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.native import listed
    from tessella.llm.personal_data import BASE, spans

    got = spans(table(spark, sf_dir, "documents"))
    counts = [F.size(k).cast("bigint").alias(f"n_{k}") for k in BASE]
    return got.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("all")).alias("spans"), "n_candidates")


@query
def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.piece_codec import encoded

    got = encoded(table(spark, sf_dir, "documents"), PIECES, spans=False)
    return got.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), F.col("covered").alias("n_span_bytes"))
