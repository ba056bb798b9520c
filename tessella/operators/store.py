"""The append-only store: proof that segments tile their source, and what is derived from manifests.

segments: key, agent, session_id, generation, path, start, end, sha256. manifests: one row for each
generation (key, agent, session_id, generation, size, file_sha256, prev_manifest_sha256, diverged_from,
manifest_sha256). files: path, length, content. Findings are rows (key, check, detail); none is a proof.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tiling(segments: DataFrame) -> DataFrame:
    """Holes and overlaps: a segment has to start where the one before it ends, the first at 0."""
    w = Window.partitionBy("key").orderBy("start", "end", "path")
    at = segments.withColumn("cursor", F.lag("end", 1, 0).over(w))
    gap = F.format_string("%s: %d where %d was due", "path", "start", "cursor")
    return at.where("start <> cursor").select("key", F.when(F.col("start") > F.col("cursor"), "hole").otherwise("overlap").alias("check"), gap.alias("detail"))


def sizes(segments: DataFrame, manifests: DataFrame) -> DataFrame:
    ends = segments.groupBy("key").agg(F.max_by("end", F.struct("start", "end")).alias("cursor"))
    got = manifests.join(ends, "key", "left").withColumn("cursor", F.coalesce("cursor", F.lit(0)))
    return got.where("size <> cursor").select("key", F.lit("size").alias("check"), F.format_string("segments end at %d, declared are %d", "cursor", "size").alias("detail"))


def segment_bytes(segments: DataFrame, files: DataFrame) -> DataFrame:
    """Missing files, wrong lengths and wrong hashes."""
    got = segments.join(files.select("path", F.octet_length("content").alias("n"), F.sha2("content", 256).alias("digest")), "path", "left")
    check = F.when(F.col("n").isNull(), "missing").when(F.col("n") != F.col("end") - F.col("start"), "segment length").when(F.col("digest") != F.col("sha256"), "segment hash")
    return got.withColumn("check", check).where("check is not null").select("key", "check", F.col("path").alias("detail"))


def _appended(parts: Column, field: str) -> Column:
    """The binary field of all parts one after another, in one pass: as digits, since a fold would copy what it has for each part."""
    return F.unhex(F.array_join(F.transform(parts, lambda p: F.hex(p[field])), ""))


def joined(segments: DataFrame, files: DataFrame) -> DataFrame:
    """key, content: bytes of each generation in order of its segments (a generation is one file, and fits a row)."""
    rows = segments.select("key", "start", "path").join(files.select("path", "content"), "path")
    parts = F.array_sort(F.collect_list(F.struct("start", "path", "content")))
    return rows.groupBy("key").agg(_appended(parts, "content").alias("content"))


def whole_hashes(segments: DataFrame, files: DataFrame, manifests: DataFrame) -> DataFrame:
    got = manifests.join(joined(segments, files).select("key", F.sha2("content", 256).alias("digest")), "key")
    return got.where("digest <> file_sha256").select("key", F.lit("whole hash").alias("check"), F.col("digest").alias("detail"))


def chain(manifests: DataFrame) -> DataFrame:
    """Generation n names generation n-1's manifest and file; generation 0 names none."""
    before = manifests.select("agent", "session_id", (F.col("generation") + 1).alias("generation"), F.col("manifest_sha256").alias("want_manifest"), F.col("file_sha256").alias("want_file"))
    got = manifests.join(before, ["agent", "session_id", "generation"], "left")
    named = F.col("prev_manifest_sha256").isNotNull() | F.col("prev_file_sha256").isNotNull()
    check = (
        F.when((F.col("generation") == 0) & named, "ancestor of the first")
        .when((F.col("generation") > 0) & F.col("want_manifest").isNull(), "ancestor missing")
        .when((F.col("generation") > 0) & ~F.col("want_manifest").eqNullSafe(F.col("prev_manifest_sha256")), "chain of manifests")
        .when((F.col("generation") > 0) & ~F.col("want_file").eqNullSafe(F.col("prev_file_sha256")), "chain of files")
    )
    return got.withColumn("check", check).where("check is not null").select("key", "check", F.lit("").alias("detail"))


def identity(manifests: DataFrame) -> DataFrame:
    """What a manifest says it is has to be where it lies: sessions/<agent>/<session>/g<NN>.json."""
    part = lambda k: F.regexp_extract("manifest_path", r"sessions/([^/]+)/([^/]+)/g(\d+)\.json$", k)
    same = (part(1) == F.col("agent")) & (part(2) == F.col("session_id")) & (part(3).try_cast("bigint") == F.col("generation"))
    return manifests.where(~F.coalesce(same, F.lit(False))).select("key", F.lit("identity").alias("check"), F.col("manifest_path").alias("detail"))


def unrecorded(segments: DataFrame, files: DataFrame) -> DataFrame:
    return files.join(segments, "path", "left_anti").select(F.regexp_extract("path", r"raw/(.+)/[^/]+$", 1).alias("key"), F.lit("unrecorded file").alias("check"), F.col("path").alias("detail"))


def verify(segments: DataFrame, manifests: DataFrame, files: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """All findings. No rows: every generation is whole, the chain holds, manifests are what they should be, and nothing lies where it shouldn't.

    manifests have a body for the check of types; listing (path, link) is of the whole store, if there is one.
    """
    from tessella.operators import proof

    found = [sizes(segments, manifests), segment_bytes(segments, files), whole_hashes(segments, files, manifests), chain(manifests), identity(manifests), unrecorded(segments, files), proof.path_containment(segments)]
    if "body" in manifests.columns:
        found.append(proof.manifest_types(manifests))
        found.append(manifests.where(F.sha2("body", 256) != F.col("manifest_sha256")).select("key", F.lit("manifest hash").alias("check"), F.col("manifest_path").alias("detail")))
    if listing is not None:
        found.append(proof.unattested(listing, manifests))
    out = tiling(segments)
    for more in found:
        out = out.unionByName(more)
    return out


def segment_groups(segments: DataFrame) -> DataFrame:
    return segments.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "path"))), lambda s: s["path"]).alias("paths"))


def live_generations(manifests: DataFrame) -> DataFrame:
    return manifests.groupBy("agent", "session_id").agg(F.max_by(F.struct("generation", "size", "key"), "generation").alias("m")).select("agent", "session_id", "m.*")


def clean_boundaries(boundaries: Column, size: Column) -> Column:
    """Offsets inside the source, once each, ascending."""
    return F.array_sort(F.array_distinct(F.filter(boundaries, lambda b: b.isNotNull() & (b >= 0) & (b <= size))))


def spans(requests: DataFrame, segments: DataFrame, files: DataFrame) -> DataFrame:
    """requests (key, offset, length) with the bytes there, over segment cuts; short where the generation is short."""
    near = requests.join(segments.select("key", "path", "start", "end"), "key").where("start < offset + length and end > offset")
    cut = F.substring(F.col("content"), F.greatest(F.col("offset") - F.col("start"), F.lit(0)).cast("int") + 1, (F.least(F.col("end"), F.col("offset") + F.col("length")) - F.greatest(F.col("start"), F.col("offset"))).cast("int"))
    rows = near.join(files.select("path", "content"), "path").select("key", "offset", "length", "start", cut.alias("part"))
    parts = F.array_sort(F.collect_list(F.struct("start", "part")))
    return rows.groupBy("key", "offset", "length").agg(_appended(parts, "part").alias("bytes"))


def session_name(path: Column) -> Column:
    """A readable stem of bounded length and a digest of the path."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1), r"[^A-Za-z0-9._-]+", "-")
    stem = F.regexp_replace(F.substring(stem, 1, 96), "^[^A-Za-z0-9]+", "")
    return F.concat(F.when(stem == "", "session").otherwise(stem), F.lit("-"), F.substring(F.sha2(path, 256), 1, 16))


def merge_spans(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start, end: overlapping and touching spans as one."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = rows.withColumn("fresh", F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0)).withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")
