"""The engine over one home folder: transcripts in, tables and answers out.

Raw bytes are the only source; every table under `derived` can be made again from them. Tables are
written to a new place and named by a pointer file, so readers see the old ones or the new ones.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import egress
from tessella.functions.text import paths
from tessella.operators import derive, detectors, proof, store, views
from tessella.plans import search
from tessella.sources import transcripts
from tessella.streaming import capture


#: Version of the tables; others are refused.
SCHEMA = 1


class Engine:
    def __init__(self, spark: SparkSession, home: str, agent: str = "agent-a"):
        self.spark, self.home, self.agent = spark, home.rstrip("/"), agent

    # Bytes

    def capture(self, root: str, pattern: str = "*.jsonl"):
        return capture.capture(self.spark, root, f"{self.home}/segments", f"{self.home}/checkpoint", pattern)

    def tick(self, roots: list[str], state: str, spool: str | None = None, **options) -> list[str]:
        """One pass over watched roots, see `capture.tick`."""
        return capture.tick(self.spark, roots, f"{self.home}/segments", state, spool, **options)

    def watch(self, roots: list[str], state: str, spool: str | None = None, **options) -> None:
        capture.watch(self.spark, roots, f"{self.home}/segments", state, spool, **options)

    def segments(self) -> DataFrame:
        rows = capture.segments_of(self.spark, f"{self.home}/segments").withColumn("agent", F.lit(self.agent)).withColumn("key", F.format_string("%s/%s", "agent", "key"))
        return rows.withColumn("path", F.format_string("raw/%s/%012d-%012d.jsonl", "key", "start", "end"))

    def manifests(self) -> DataFrame:
        """Manifests of all generations as they are now, see `proof.sealed`."""
        order = F.array_sort(F.collect_list(F.struct("start", "path")))
        rows = self.segments().groupBy("session_id", "generation").agg(F.max("end").alias("size"), F.max_by("prefix_sha256", "end").alias("file_sha256"), F.transform(order, lambda s: s["path"]).alias("segments"))
        return proof.sealed(rows.withColumns({"agent": F.lit(self.agent), "compact_boundaries": F.array().cast("array<bigint>"), "source_path": F.lit(None).cast("string")}))

    def seal(self) -> None:
        """Writes the manifests; `verify` holds the store against them from now on."""
        place = f"{self.home}/manifests/{uuid.uuid4().hex}"
        self.manifests().write.parquet(place)
        self._point("sealed", place)

    def verify(self) -> DataFrame:
        """Findings against the proof; none means that all bytes are there. Before the first seal there are no manifests to hold them against."""
        rows = self.segments()
        files = rows.select("path", F.octet_length("content").cast("bigint").alias("length"), "content")
        place = self._pointed("sealed")
        if place is None:
            heads = rows.groupBy("key").agg(F.max("end").alias("size"), F.max_by("prefix_sha256", "end").alias("file_sha256"))
            found = store.tiling(rows)
            for more in (store.sizes(rows, heads), store.segment_bytes(rows, files), store.whole_hashes(rows, files, heads), proof.path_containment(rows)):
                found = found.unionByName(more)
            return found
        manifests = self.spark.read.parquet(place)
        listing = rows.select("path", F.lit(False).alias("link")).unionByName(manifests.select(F.col("manifest_path").alias("path"), F.lit(False).alias("link")))
        return store.verify(rows, manifests, files, listing)

    def generations(self) -> DataFrame:
        """path (the generation's key), content."""
        rows = self.segments()
        return store.joined(rows, rows.select("path", "content")).withColumnRenamed("key", "path")

    # Tables

    def _point(self, name: str, place: str) -> None:
        self.spark.range(1).select(F.lit(place).alias("place"), F.lit(SCHEMA).alias("schema")).coalesce(1).write.mode("overwrite").json(f"{self.home}/{name}")

    def _pointed(self, name: str) -> str | None:
        try:
            row = self.spark.read.schema("place string, schema int").json(f"{self.home}/{name}").first()
        except AnalysisException:
            return None
        if row and row.schema != SCHEMA:
            raise ValueError(f"{name}: tables of schema {row.schema}, this is {SCHEMA}; index again")
        return row.place if row else None

    def table(self, name: str) -> DataFrame:
        place = self._pointed("current")
        if place is None:
            raise FileNotFoundError("no index yet")
        return self.spark.read.parquet(f"{place}/{name}")

    def index(self) -> None:
        """Parses every generation once, and writes turns, blocks, events, skips and the inverted index."""
        place = f"{self.home}/parsed/{uuid.uuid4().hex}"
        transcripts.parsed(self.generations(), self.agent).write.parquet(place)
        found = self.spark.read.parquet(place)
        generation = F.regexp_extract("path", r"/g(\d+)$", 1).cast("int")
        rows = transcripts.blocks(found).withColumn("generation", generation).withColumn("session_key", F.col("path"))
        rows = rows.withColumn("paths", F.array_join(paths(F.concat_ws("\n", "prose", "tool_use", "tool_result")), "\n"))
        turns = transcripts.turns(found).withColumn("generation", generation).withColumn("session_key", F.col("path")).drop("blocks")
        events = transcripts.events(found).withColumn("session_key", F.col("path"))
        place = f"{self.home}/derived/{uuid.uuid4().hex}"
        # Row ids are given once, where rows are written: no hash can make two rows one.
        rows.withColumn("row_id", F.monotonically_increasing_id()).write.parquet(f"{place}/blocks")
        rows = self.spark.read.parquet(f"{place}/blocks")
        search.postings(rows).sort("term").write.parquet(f"{place}/postings")
        count, tokens = search.corpus(rows)
        totals = self.spark.range(1).select(F.lit(count).cast("bigint").alias("rows"), F.lit(tokens).cast("bigint").alias("tokens"))
        for name, df in {"turns": turns, "events": events, "skips": transcripts.skips(found), "totals": totals}.items():
            df.write.parquet(f"{place}/{name}")
        self._point("current", place)

    def derive(self, count: int = 8) -> DataFrame:
        """Writes ideas, timeline and graph of every generation, one row of JSON each, and returns their counts. Nothing is written if one of them holds a credential."""
        place = f"{self.home}/artefacts/{uuid.uuid4().hex}"
        mark = lambda name: self.table(name)
        made = derive.artefacts(mark("blocks"), mark("turns"), mark("events"), count)
        draft = f"{place}-draft"
        made.write.parquet(draft)
        made = self.spark.read.parquet(draft)
        found = egress.leaks(detectors.scan(made.select(F.concat_ws("/", "session_key", "artefact").alias("path"), F.col("payload").cast("binary").alias("content"))))
        leaked = found.select("path", "detector").first()
        if leaked:
            raise ValueError(f"{leaked.path}: holds a credential ({leaked.detector}); nothing is written")
        made.write.partitionBy("artefact").json(place)
        self._point("derived-current", place)
        return derive.derive_stats(made)

    def artefacts(self) -> DataFrame:
        place = self._pointed("derived-current")
        if place is None:
            raise FileNotFoundError("nothing derived yet")
        return self.spark.read.schema("session_key string, payload string, artefact string").json(place)

    # Answers

    def _totals(self) -> tuple[int, int]:
        row = self.table("totals").first()
        return row.rows, row.tokens

    def recall(self, query: str, k: int = 10, policy: str = "latest-user") -> DataFrame:
        """The k best turns, in the order of a policy: one of `search.POLICIES`, or module:function. Texts are read of these only."""
        hits = search.search(self.table("blocks"), query, k, index=self.table("postings"), totals=self._totals())
        return search.reorder(policy)(hits)

    def retriever(self) -> Callable[[str, int], list[int]]:
        return search.retriever(self.table("blocks"), self.table("postings"), self._totals())

    def _generation_rows(self) -> DataFrame:
        """One row for each generation, as the views over generations want it."""
        turns, blocks = self.table("turns"), self.table("blocks")
        sizes = self.segments().groupBy(F.col("key").alias("session_key"), "session_id", "agent", "generation").agg(F.count("*").alias("segments"), F.max("end").alias("bytes"))
        n = turns.groupBy("session_key").agg(F.count("*").alias("turns"))
        m = blocks.groupBy("session_key").agg(F.count("*").alias("blocks"))
        c = self.table("events").where("kind = 'compaction'").groupBy("session_key").agg(F.count("*").alias("compactions"))
        rows = sizes.join(n, "session_key", "left").join(m, "session_key", "left").join(c, "session_key", "left").na.fill(0, ["turns", "blocks", "compactions"])
        return rows.withColumn("parsed", F.col("turns") > 0).withColumn("skip_reason", F.when(~F.col("parsed"), "no turns"))

    def corpus(self) -> DataFrame:
        return views.corpus(self._generation_rows())

    def contiguity(self) -> DataFrame:
        return views.contiguity(self._generation_rows())

    def requests(self) -> DataFrame:
        return views.requests(self.table("turns"))

    def unmeasured(self) -> DataFrame:
        return views.unmeasured(self.spark)

    def sessions(self) -> DataFrame:
        """Newest generation of each session: agent, session_id, generation, size, key."""
        return store.live_generations(self.manifests().select("agent", "session_id", "generation", "size", "key"))

    def spend(self) -> DataFrame:
        return views.spend(self.table("turns"))

    def unbilled(self) -> DataFrame:
        return views.unbilled(self.table("turns"))

    def growth(self) -> DataFrame:
        return views.growth(self.table("turns"))

    def timeline(self) -> DataFrame:
        mark = lambda df: df.withColumn("session_id", F.col("path"))
        return derive.timeline(mark(self.table("turns")), mark(self.table("events")))

    def ideas(self, count: int = 8) -> DataFrame:
        return derive.ideas(self.table("blocks").where("kind = 'text'"), count)

    def graph(self) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges) of the decisions."""
        found = derive.decisions(self.table("blocks"))
        return derive.graph_nodes(found), derive.succession(found, "session_key", ["byte_offset", "block_id"], "block_id")

    def gate(self) -> bool:
        """Whether nothing in the store, also over cuts between segments, is a credential that blocks."""
        segments = self.segments()
        findings = detectors.scan(segments.select("path", "content")).unionByName(detectors.seams(segments))
        return detectors.gate(segments.count(), findings)


def read_span(engine: Engine, key: str, offset: int, length: int) -> bytes:
    """Bytes of a generation, over segment cuts."""
    segments = engine.segments()
    asked = engine.spark.createDataFrame([(key, offset, length)], "key string, offset bigint, length bigint")
    row = store.spans(asked, segments, segments).first()
    return bytes(row.bytes) if row else b""
