"""Proof beyond the bytes: what manifests say, where files lie, and segments that no manifest has taken up yet.

Listings are tables (path, link): paths are relative to the store, link says that the entry is a symbolic one.
Findings are rows (key, check, detail), as those of `store`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fields of a manifest: JSON kind, and whether it may be absent or null.
FIELDS = {
    "size": ("integer", False),
    "file_sha256": ("string", False),
    "segments": ("array", False),
    "compact_boundaries": ("array", False),
    "diverged_from": ("object", True),
    "prev_manifest_sha256": ("string", True),
    "source_path": ("string", True),
    "adopted": ("array", True),
}
SAFE = r"[A-Za-z0-9][A-Za-z0-9._-]{0,127}"


def safe_name(name: Column) -> Column:
    """Whether a name can be one path component: letters, digits, dots, lines, and no dot or line first."""
    return F.coalesce(name.rlike(rf"^{SAFE}\z"), F.lit(False))


def _kind(value: Column) -> Column:
    """The JSON kind of a variant; null for an absent field, `null` for a null."""
    name = F.schema_of_variant(value)
    return (
        F.when(value.isNull(), None).when(name.rlike("^(BIGINT|TINYINT|SMALLINT|INT|DECIMAL\\(\\d+,0\\))$"), "integer").when(name.rlike("^(DOUBLE|FLOAT|DECIMAL)"), "number")
        .when(name == "STRING", "string").when(name == "BOOLEAN", "boolean").when(F.startswith(name, F.lit("ARRAY")), "array").when(F.startswith(name, F.lit("OBJECT")), "object").when(name == "VOID", "null").otherwise(name)
    )


def manifest_types(manifests: DataFrame) -> DataFrame:
    """Manifests (key, body) that are no object, or of which a field is missing or of another kind."""
    rows = manifests.select("key", F.try_parse_json("body").alias("v"))
    field = lambda n: _kind(F.try_variant_get("v", f"$.{n}", "variant"))
    found = F.array(*(F.struct(F.lit(n).alias("field"), F.lit(kind).alias("want"), F.lit(free).alias("free"), field(n).alias("got")) for n, (kind, free) in FIELDS.items()))
    object_ = F.coalesce(_kind(F.col("v")) == "object", F.lit(False))
    wrong = F.filter(found, lambda f: ~F.coalesce(f["got"] == f["want"], F.lit(False)) & ~(f["free"] & F.coalesce(f["got"] == "null", F.lit(True))))
    said = F.transform(wrong, lambda f: F.concat_ws(" ", f["field"], F.coalesce(f["got"], F.lit("missing"))))
    detail = F.when(object_, said).otherwise(F.array(F.lit("not an object")))
    return rows.select("key", F.lit("manifest type").alias("check"), F.explode(detail).alias("detail"))


def normalised(path: Column) -> Column:
    """A relative path without empty parts, `.` and `..`; null where it is absolute or leaves its root."""
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(False).alias("out"))

    def step(t: Column, p: Column) -> Column:
        up = F.struct(F.slice(t["parts"], 1, F.greatest(F.size(t["parts"]) - 1, F.lit(0))).alias("parts"), (t["out"] | (F.size(t["parts"]) == 0)).alias("out"))
        return F.when(p.isin("", "."), t).when(p == "..", up).otherwise(F.struct(F.concat(t["parts"], F.array(p)).alias("parts"), t["out"].alias("out")))

    return F.when(~F.startswith(path, F.lit("/")), F.aggregate(F.split(path, "/"), start, step, lambda t: F.when(~t["out"], F.array_join(t["parts"], "/"))))


def path_containment(segments: DataFrame) -> DataFrame:
    """Segments (key, agent, session_id, path) whose path leaves the store or its session's folder."""
    rows = segments.withColumn("at", normalised(F.col("path")))
    own = F.concat(F.lit("raw/"), F.col("agent"), F.lit("/"), F.col("session_id"))
    inside = (F.col("at") == own) | F.startswith("at", F.concat(own, F.lit("/")))
    check = F.when(F.col("at").isNull(), "escapes the store").when(~F.coalesce(inside, F.lit(False)), "outside the session's folder")
    return rows.withColumn("check", check).where("check is not null").select("key", "check", F.col("path").alias("detail"))


def unattested(listing: DataFrame, manifests: DataFrame) -> DataFrame:
    """Entries of a listing that no manifest speaks for, by manifests (agent, session_id, generation) that lie where they say.

    Under raw/ all outside the folder of a generation with a manifest; under sessions/ all but manifests at
    their depth; links anywhere in both.
    """
    rows = listing.where("path like 'raw/%' or path like 'sessions/%'").withColumn("dir", F.regexp_extract("path", r"^raw/([^/]+/[^/]+/g\d+)/", 1))
    said = manifests.select(F.format_string("%s/%s/g%02d", "agent", "session_id", "generation").alias("dir")).distinct().withColumn("attested", F.lit(True))
    rows = rows.join(said, "dir", "left")
    raw = F.startswith("path", F.lit("raw/"))
    check = F.when(F.col("link"), "symlink").when(raw & F.col("attested").isNull(), "no manifest").when(~raw & ~F.col("path").rlike(r"^sessions/[^/]+/[^/]+/g\d+\.json$"), "not a manifest")
    return rows.withColumn("check", check).where("check is not null").select(F.regexp_extract("path", r"^(?:raw|sessions)/([^/]+/[^/]+)", 1).alias("key"), "check", F.col("path").alias("detail"))


def adopted(heads: DataFrame, orphans: DataFrame) -> DataFrame:
    """Orphans (key, path, start, end) that carry on a generation (key, size) without a hole, in order: key, path, start, end, place from 1.

    Of several with one start the longest counts, and of those the first by path. One window: a row is taken as
    long as every row before it began where the one before that ended.
    """
    order = Window.partitionBy("key", "start").orderBy(F.desc("end"), "path")
    rows = orphans.where(F.col("end") > F.col("start")).join(heads.select("key", "size"), "key").where("start >= size")
    rows = rows.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")
    w = Window.partitionBy("key").orderBy("start")
    due = F.coalesce(F.lag("end").over(w), F.col("size"))
    rows = rows.withColumn("due", due)
    rows = rows.withColumn("holes", F.sum(F.when(F.col("start") == F.col("due"), 0).otherwise(1)).over(w))
    return rows.where("holes = 0").select("key", "path", "start", "end", F.row_number().over(w).cast("bigint").alias("place"))


BODY = ("adopted", "agent", "compact_boundaries", "diverged_from", "file_sha256", "generation", "prev_file_sha256", "prev_manifest_sha256", "segments", "session_id", "size", "source_path")


def sealed(generations: DataFrame) -> DataFrame:
    """Manifests of generations (agent, session_id, generation, size, file_sha256, segments, compact_boundaries, source_path): key, manifest_path, body, manifest_sha256 and the fields.

    A body is JSON with its keys in order. Each names the hash of its predecessor's body and bytes, so a session's
    generations are folded once, in order; a session has few.
    """
    fields = ["generation", "size", "file_sha256", "segments", "compact_boundaries", "source_path"]
    rows = generations.groupBy("agent", "session_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("g"))

    def body(g: Column, manifest: Column, file: Column) -> Column:
        before = F.when(g["generation"] > 0, F.struct(file.alias("file_sha256"), (g["generation"] - 1).alias("generation")))
        values = {"adopted": F.array().cast("array<string>"), "agent": F.col("agent"), "session_id": F.col("session_id"), "diverged_from": before, "prev_manifest_sha256": manifest, "prev_file_sha256": file, **{n: g[n] for n in fields}}
        return F.to_json(F.struct(*(values[n].alias(n) for n in BODY)), {"ignoreNullFields": "false"})

    one = "struct<generation:int,body:string,sha:string,file:string,prev_manifest_sha256:string,prev_file_sha256:string>"

    def step(done: Column, g: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        linked = F.when(last["generation"] == g["generation"] - 1, last)
        text = body(g, linked["sha"], linked["file"])
        return F.concat(done, F.array(F.struct(g["generation"].cast("int").alias("generation"), text.alias("body"), F.sha2(text, 256).alias("sha"), g["file_sha256"].alias("file"), linked["sha"].alias("prev_manifest_sha256"), linked["file"].alias("prev_file_sha256"))))

    rows = rows.withColumn("m", F.aggregate("g", F.array().cast(f"array<{one}>"), step)).withColumn("m", F.arrays_zip("g", "m"))
    m = rows.select("agent", "session_id", F.explode("m").alias("x")).select("agent", "session_id", *(f"x.g.{n}" for n in fields), F.col("x.m.body").alias("body"), F.col("x.m.sha").alias("manifest_sha256"), "x.m.prev_manifest_sha256", "x.m.prev_file_sha256")
    key, path = F.format_string("%s/%s/g%02d", "agent", "session_id", "generation"), F.format_string("sessions/%s/%s/g%02d.json", "agent", "session_id", "generation")
    return m.select(key.alias("key"), path.alias("manifest_path"), *m.columns)


def content_digest(rows: DataFrame) -> DataFrame:
    """rows, sha256: one digest of a table, whatever order its rows come in: of the sorted digests of its rows by bucket.

    A row's digest is of its JSON; buckets are of the first two hex digits, so no task holds more than a 256th.
    """
    each = rows.select(F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256).alias("h"))
    buckets = each.groupBy(F.substring("h", 1, 2).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("d"), F.count("*").alias("n"))
    return buckets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), ""), 256).alias("sha256"))
