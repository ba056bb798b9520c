"""Finding sessions: generations by their manifests, and transcripts by their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import proof


def sessions_scan(manifests: DataFrame, strict: bool = False) -> DataFrame:
    """Readable generations (key, agent, session_id, generation, size, file_sha256, segments) of manifests (key, agent, session_id, generation, body).

    A manifest of wrong types is left out, or an error if strict; a segment path that leaves the store or its
    session's folder is always an error, as it would lead the gate past bytes.
    """
    bad = proof.manifest_types(manifests).select("key").distinct()
    if strict:
        first = bad.first()
        if first:
            raise ValueError(f"{first.key}: the manifest can't be read")
    good = manifests.join(bad, "key", "left_anti")
    body = F.from_json("body", "size bigint, file_sha256 string, segments array<string>")
    rows = good.select("key", "agent", "session_id", "generation", body.alias("m")).select("key", "agent", "session_id", "generation", "m.*")
    out = proof.path_containment(rows.select("key", "agent", "session_id", F.explode("segments").alias("path"))).first()
    if out:
        raise ValueError(f"{out.key}: {out.detail} {out.check}")
    return rows


def listing(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    """path, mtime and size of the files under a root of any store; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


def find_session(files: DataFrame, session: str) -> DataFrame:
    """The newest file whose name is the session's id (without its suffix), or ends in it after a line; of several the last by path. No row: none."""
    stem = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    named = files.where((stem == session) | F.endswith(stem, F.lit(f"-{session}")) | F.endswith(stem, F.lit(f"_{session}")))
    return named.agg(F.max_by("path", F.struct("mtime", "path")).alias("path")).where("path is not null")


def session_files(files: DataFrame, path: str) -> DataFrame:
    """A transcript and those of its subagents: the files in the folder of its name. Each once."""
    folder = path.rsplit(".", 1)[0] + "/"
    return files.where((F.col("path") == path) | F.startswith("path", F.lit(folder))).select("path").distinct()
