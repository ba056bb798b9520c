"""A corpus pipeline of five stages over documents; each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm import decontaminate, personal_data, piece_codec, quality, shingle_join
from tessella.llm.queries import PIECES
from tessella.llm.scratch import stored

#: SQL has no tokenizer and no boosted trees; the stages are tested against a brute-force version.
ORACLE_SQL = None


#: Key of a row inside a stage; doc_id may be null or repeated.
KEY = "row_key"


#: Files whose names are sent to every task; more of them are joined by name.
BROADCAST_FILES = 100_000


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a key for each row that doesn't change when rows are read again: the file's place among all names and the row's in it. What isn't read from files is written first."""
    try:
        paths = docs.select(F.col("_metadata.file_path").alias("file")).distinct()
    except AnalysisException:
        return _keyed(stored(docs, "keyed"))
    files = stored(paths.withColumn("place", F.row_number().over(Window.orderBy("file")).cast("bigint")), "files")
    files = F.broadcast(files) if files.count() <= BROADCAST_FILES else files
    rows = docs.select(*docs.columns, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return rows.join(files, "file").withColumn(KEY, F.shiftleft(F.col("place"), 40) + F.col("row")).select(*docs.columns, KEY)


#: Keys of dropped rows that are sent to every task, 8 bytes each; more of them meet the rows in order of keys.
BROADCAST_KEYS = 2_000_000


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of keyed docs whose key isn't among gone's, in docs' columns. Kept ones are most of the table: those dropped are joined."""
    gone = stored(gone.select(KEY), "gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone.hint("merge")
    return docs.join(gone, KEY, "left_anti").drop(KEY)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the fertility bands reject."""
    docs = _keyed(docs)
    return _without(docs, quality.judged(docs, PIECES, id_column=KEY).where(~F.col("kept")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that of the smallest id, null being the largest."""
    docs = _keyed(docs)
    classes = stored(shingle_join.classes(docs, id_column=KEY).select(KEY, "component_id"), "classes")
    # A class of one row is its own; only rows of the others are looked at.
    shared = classes.where(F.col("component_id") != F.col(KEY)).select("component_id").distinct()
    rows = classes.join(shared, "component_id", "left_semi").join(docs.select(KEY, "doc_id").hint("merge"), KEY)
    first = rows.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", KEY))[KEY].alias("first"))
    return _without(docs, rows.join(first, "component_id").where(F.col(KEY) != F.col("first")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark, items without an id included."""
    docs = _keyed(docs)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, decontaminate.contamination(docs, benchmark, id_column=KEY).where("n_hit > 0"))


def personal_data_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, personal data replaced by [KIND]; n_chars is that of the new text."""
    found = personal_data.spans(docs, also=("lang", "source"))
    text = personal_data.redacted(F.col("text"), F.col("all"))
    return found.select("doc_id", text.alias("text"), "lang", "source").select("doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit) and spans (binary, int32 pairs of byte start and end) of every document."""
    return piece_codec.encoded(docs, PIECES, spans=True, decoded=False).select("doc_id", "n_tokens", "ids", "spans")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data_redaction),
    ("SentencePiece encoding", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage{k + 1}")
    return docs
