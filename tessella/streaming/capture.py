"""Capture of growing files as a stream: new bytes become segments, a rewrite begins a new generation.

A source lists files and offers what each has grown by; the sink appends it to a table of segments. What
has been captured is the table itself: a micro-batch that runs again finds its segments there and adds
nothing. Files are read by the driver's watch, as an agent's logs lie on the machine that writes them;
their bytes go to the store's shared folder.
"""

from __future__ import annotations

import glob
import hashlib
import json
import os
import stat
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SEGMENTS = "key string, session_id string, generation int, start bigint, end bigint, sha256 string, prefix_sha256 string, content binary"
TAIL = "path string, size bigint, content binary"

#: Hook events that force a capture, and the seconds of quiet after which growth is captured anyway.
FORCED = frozenset(["PreCompact", "SessionEnd"])
INTERVAL = 3600.0


def due(changed: bool, forced: bool, captured: bool, idle: float, interval: float = INTERVAL) -> bool:
    """Whether a source is captured now."""
    return changed and (forced or not captured or idle >= interval)


class TailReader(SimpleDataSourceStreamReader):
    """Offsets are the known size and time of change of each file; a batch has the whole bytes of those that changed."""

    def __init__(self, root: str, pattern: str):
        self.root, self.pattern = root, pattern

    def initialOffset(self) -> dict:  # noqa: N802  the interface's name
        return {}

    def _state(self) -> dict[str, list[int]]:
        out = {}
        for path in sorted(glob.glob(os.path.join(self.root, "**", self.pattern), recursive=True)):
            if os.path.isfile(path) and not os.path.islink(path):
                s = os.stat(path)
                out[path] = [s.st_size, s.st_mtime_ns]
        return out

    def _rows(self, paths: list[str], state: dict):
        for path in paths:
            with open(path, "rb") as f:
                yield path, state[path][0], f.read(state[path][0])

    def read(self, start: dict):
        state = self._state()
        changed = [p for p in state if start.get(p) != state[p]]
        return iter(list(self._rows(changed, state))), {**start, **state}

    def readBetweenOffsets(self, start: dict, end: dict):  # noqa: N802
        return self._rows([p for p in end if start.get(p) != end[p] and os.path.exists(p)], end)


class TailSource(DataSource):
    """spark.readStream.format("tail").option("root", …).option("pattern", "*.jsonl")"""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return TAIL

    def simpleStreamReader(self, schema) -> TailReader:  # noqa: N802
        return TailReader(self.options["root"], self.options.get("pattern", "*.jsonl"))


def session_id(path: str) -> str:
    stem = os.path.splitext(os.path.basename(path))[0][:96]
    return f"{stem}-{hashlib.sha256(os.path.realpath(path).encode()).hexdigest()[:16]}"


def segments_of(spark: SparkSession, store: str) -> DataFrame:
    """Segments of a store, none if it is new."""
    try:
        return spark.read.schema(SEGMENTS.replace(" end ", " `end` ")).parquet(store)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], SEGMENTS.replace(" end ", " `end` "))


def heads(segments: DataFrame) -> DataFrame:
    """Of each session the newest generation: session_id, generation, size, prefix_sha256 (of all its bytes)."""
    last = F.max_by(F.struct("generation", F.col("end").alias("size"), "prefix_sha256"), F.struct("generation", "end"))
    return segments.groupBy("session_id").agg(last.alias("h")).select("session_id", "h.*")


def grown(batch: DataFrame, known: DataFrame) -> DataFrame:
    """SEGMENTS that a batch of TAIL rows adds to known heads: the bytes after a prefix that is still the same, or all bytes as a new generation."""
    name = F.udf(session_id, "string")
    # Of several states of a file in one batch the longest is the last.
    rows = batch.withColumn("session_id", name("path")).withColumn("rn", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("size")))).where("rn = 1").drop("rn")
    rows = rows.withColumnRenamed("size", "now").join(known, "session_id", "left")
    same = F.col("size").isNotNull() & (F.col("now") >= F.col("size")) & (F.sha2(F.substring("content", F.lit(1), F.col("size").cast("int")), 256) == F.col("prefix_sha256"))
    rows = rows.withColumn("same", F.coalesce(same, F.lit(False))).where("not same or now > size").where("now > 0")
    start = F.when(F.col("same"), F.col("size")).otherwise(F.lit(0)).cast("bigint")
    generation = F.when(F.col("same"), F.col("generation")).when(F.col("size").isNull(), 0).otherwise(F.col("generation") + 1)
    part = F.expr("substring(content, cast(start as int) + 1, cast(now - start as int))")
    rows = rows.withColumn("start", start).withColumn("g", generation.cast("int")).withColumn("part", part)
    return rows.select(
        F.format_string("%s/g%02d", "session_id", "g").alias("key"), "session_id", F.col("g").alias("generation"), "start", F.col("now").alias("end"), F.sha2("part", 256).alias("sha256"), F.sha2("content", 256).alias("prefix_sha256"), F.col("part").alias("content")
    )


def sink(spark: SparkSession, store: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function. Bytes that are in the store already are no growth, so a batch may run twice."""

    def write(batch: DataFrame, _: int) -> None:
        new = grown(batch, heads(segments_of(batch.sparkSession, store)))
        rows = new.persist()
        try:
            if not rows.isEmpty():
                rows.coalesce(1).write.mode("append").parquet(store)
        finally:
            rows.unpersist()

    return write


def capture(spark: SparkSession, root: str, store: str, checkpoint: str, pattern: str = "*.jsonl", once: bool = True, every: str = "5 seconds"):
    """Starts the stream from files under root to a store; once: what is there now, and then it ends."""
    spark.dataSource.register(TailSource)
    rows = spark.readStream.format("tail").option("root", root).option("pattern", pattern).load()
    writer = rows.writeStream.foreachBatch(sink(spark, store)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def discover(roots: list[str], pattern: str = "*.jsonl") -> dict[str, os.stat_result]:
    """Regular files under the roots, no links, each once whatever its names: of several the one under the deepest root, then the first by path."""
    found: dict[tuple[int, int], tuple[int, str, os.stat_result]] = {}
    for root in roots:
        depth = os.path.realpath(root).count(os.sep)
        for path in glob.glob(os.path.join(root, "**", pattern), recursive=True):
            s = os.lstat(path)
            if stat.S_ISREG(s.st_mode):
                best = (-depth, os.path.abspath(path), s)
                found[s.st_dev, s.st_ino] = min(found.get((s.st_dev, s.st_ino), best), best, key=lambda x: x[:2])
    return {path: s for _, path, s in sorted(found.values(), key=lambda x: x[1])}


def drain(spool: str | None) -> set[str]:
    """Transcripts that hooks force a capture of: each firing is a file `<event>-<anything>.json` with transcript_path. Read firings are removed, broken ones too."""
    forced = set()
    for path in sorted(glob.glob(os.path.join(spool, "*.json"))) if spool else []:
        try:
            with open(path, "rb") as f:
                body = json.load(f)
            if os.path.basename(path).split("-")[0] in FORCED and isinstance(body, dict) and isinstance(body.get("transcript_path"), str):
                forced.add(os.path.realpath(body["transcript_path"]))
        except ValueError:
            pass
        os.unlink(path)
    return forced


def tick(spark: SparkSession, roots: list[str], store: str, state: str, spool: str | None = None, pattern: str = "*.jsonl", interval: float = INTERVAL, now: float | None = None) -> list[str]:
    """One pass over several roots: sources that are due are captured together, and their paths returned.

    `state` is a file on the driver's disk with what each source was like when it was captured; it is written after
    the bytes are in the store, so a pass that fails is made again. A file that can't be read is passed over.
    """
    now = time.time() if now is None else now
    forced = drain(spool)
    try:
        with open(state) as f:
            before = json.load(f)
    except (FileNotFoundError, ValueError):
        before = {}
    rows, seen = [], {}
    for path, s in discover(roots, pattern).items():
        mark = [s.st_size, s.st_mtime_ns]
        if due(before.get(path) != mark, os.path.realpath(path) in forced, path in before, now - s.st_mtime, interval):
            try:
                with open(path, "rb") as f:
                    rows.append((path, s.st_size, bytearray(f.read(s.st_size))))
                seen[path] = mark
            except OSError:
                continue
    if rows:
        sink(spark, store)(spark.createDataFrame(rows, TAIL), 0)
        with open(f"{state}.new", "w") as f:
            json.dump({**before, **seen}, f)
        os.replace(f"{state}.new", state)
    return sorted(seen)


def watch(spark: SparkSession, roots: list[str], store: str, state: str, spool: str | None = None, pattern: str = "*.jsonl", pause: float = 5.0, stop: Callable[[], bool] = lambda: False, passed: Callable[[list[str] | Exception], None] = lambda _: None) -> None:
    """Passes again and again; one that fails doesn't end it and is told to `passed`, as are the paths that others captured."""
    while not stop():
        try:
            passed(tick(spark, roots, store, state, spool, pattern))
        except Exception as e:  # noqa: BLE001
            passed(e)
        time.sleep(pause)
