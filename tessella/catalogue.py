"""The engine's operators as queries over the given tables, each with the SQL that gives the same rows.

The tables hold no transcripts, so conversations stand for turns and blocks, events for requests, usage
and marks, orders for segments and chains, documents for texts. Mappings are SQL that both engines read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import derive, detectors, evaluate, harness, store, views
from tessella.plans import search as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query, and the SQL for it if there is any."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mapped(spark: SparkSession, sf_dir: str, name: str, sql: str) -> DataFrame:
    """A mapping's rows: sql reads its table as {t}."""
    return spark.sql(sql, t=table(spark, sf_dir, name))


#: Turns of conversations: one text block each, its offset the bytes before it, its row id from both keys.
CONV = """SELECT conv_id * 1000000 + turn AS row_id, 'c' || conv_id AS session_id, 'conv/c' || conv_id || '/g00' AS session_key, 'conv' AS agent, 'c' || conv_id || '-' || turn AS turn_id,
 0 AS generation, 0 AS block_seq, turn AS seq, role, 'text' AS kind, COALESCE(text, '') AS prose, octet_length({utf8}) AS byte_len,
 CAST(COALESCE(SUM(octet_length({utf8}) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset,
 CASE WHEN turn % 5 = 0 THEN NULL ELSE '20' || (10 + conv_id % 15) || '-01-' || (10 + turn % 19) || 'T10:00:00Z' END AS ts
 FROM {t}"""
CONV_SPARK = CONV.replace("{utf8}", "COALESCE(text, '')")
CONV_DUCK = CONV.replace("octet_length({utf8})", "strlen(COALESCE(text, ''))").replace("{t}", "conversations")

#: Events as turns with usage.
USAGE = """SELECT event_id AS seq, event_type AS agent, 'u' || (user_id % 40) AS session_id, event_type || '/u' || (user_id % 40) || '/g0' || (event_id % 3) AS session_key, event_id % 3 AS generation,
 CASE WHEN event_id % 4 = 0 THEN 'user' ELSE 'assistant' END AS role, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN '<synthetic>' ELSE 'm' || (user_id % 3) END AS model,
 CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'r' || user_id END AS request_id, CAST(NULL AS {string}) AS uuid, event_id * 100 AS byte_offset, length(props) AS byte_len,
 CASE WHEN event_id % 17 = 0 THEN 'not-a-date' WHEN event_id % 17 = 1 THEN '' ELSE {stamp} END AS ts,
 CASE WHEN event_id % 13 = 0 THEN '{{}}' ELSE '{{"input_tokens": ' || regexp_extract(props, '([0-9]+)', 1) || ', "cache_read_input_tokens": ' || (event_id % 900) || ', "output_tokens": ' || (event_id % 100) || '}}' END AS usage
 FROM {t}"""
USAGE_SPARK = USAGE.replace("{stamp}", "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'+02:00'\")").replace("{string}", "STRING")
USAGE_DUCK = USAGE.replace("{stamp}", "strftime(ts, '%Y-%m-%dT%H:%M:%S+02:00')").replace("{string}", "VARCHAR").replace("{{", "{").replace("}}", "}").replace("{t}", "events")

#: Orders as generations, and as segments of which every 13th is missing and every 17th too long.
GENERATIONS = """SELECT o_orderpriority AS agent, 's' || (o_custkey % 500) AS session_id, o_orderkey AS generation, 1 + o_orderkey % 4 AS segments, CAST(floor(o_totalprice) AS BIGINT) AS bytes,
 o_orderkey % 3 AS compactions, o_orderkey % 9 AS turns, o_orderkey % 21 AS blocks, o_orderkey % 10 <> 0 AS parsed, CASE WHEN o_orderkey % 10 = 0 THEN 'error ' || o_orderkey END AS skip_reason FROM {t}"""
SEGMENTS = """SELECT 'k' || o_custkey AS key, 'p' || o_orderkey AS path, o_orderkey AS o, CAST(SUM(1 + o_orderkey % 97) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - (1 + o_orderkey % 97) AS BIGINT) AS start,
 CAST(SUM(1 + o_orderkey % 97) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + CASE WHEN o_orderkey % 17 = 0 THEN 3 ELSE 0 END AS BIGINT) AS "end" FROM {t}"""
SEGMENTS_SPARK = SEGMENTS.replace('"end"', "`end`")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mapped(spark, sf_dir, "conversations", CONV_SPARK)
    return rows.withColumns({"tool_use": F.lit(""), "tool_result": F.lit(""), "paths": F.lit("")})


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped(spark, sf_dir, "events", USAGE_SPARK)


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped(spark, sf_dir, "orders", SEGMENTS_SPARK).where("o % 13 <> 0").drop("o")


SEGMENTS_DUCK = f"SELECT * EXCLUDE (o) FROM ({SEGMENTS.replace('{t}', 'orders')}) WHERE o % 13 <> 0"

# Retrieval

ASKED = "éonierç the la region the"
_TOKENS = "regexp_extract_all(lower(strip_accents({x})), '[\\p{L}\\p{N}\\p{Co}]+')"


def _tokens(x: str) -> str:
    return _TOKENS.replace("{x}", x)


def _bm25(columns: dict[str, tuple[str, float]]) -> str:
    """CTEs up to scores(row_id, score) over b; columns: text expression and weight by name."""
    lists = ", ".join(f"{_tokens(x)} AS {c}" for c, (x, _) in columns.items())
    f = " + ".join(f"{w} * len(list_filter({c}, lambda t: t = term))" for c, (_, w) in columns.items())
    dl = " + ".join(f"len({c})" for c in columns)
    terms = ", ".join(f"({i}, '{t[0]}')" for i, t in enumerate(S.query_terms(ASKED)[0]))
    return f"""b AS ({CONV_DUCK}), tok AS (SELECT row_id, {lists} FROM b), d AS (SELECT *, {dl} AS dl FROM tok), q(ord, term) AS (VALUES {terms}),
st AS (SELECT count(*) AS n, sum(dl) / count(*) AS avgdl FROM d), tf AS (SELECT row_id, dl, ord, {f} AS f FROM d, q),
df AS (SELECT ord, count(*) AS m FROM tf WHERE f > 0 GROUP BY ord), idf AS (SELECT ord, CASE WHEN ln((n - m + 0.5) / (m + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - m + 0.5) / (m + 0.5)) END AS idf FROM df, st),
scores AS (SELECT row_id, -sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN idf USING (ord), st WHERE f > 0 GROUP BY row_id)"""


_PLAIN = _bm25({"prose": ("prose", 4.0)})
_TOP = f"WITH {_PLAIN}, top AS (SELECT *, row_number() OVER (ORDER BY score, session_key, byte_offset) AS rank FROM scores JOIN b USING (row_id)) "
_HITS = _TOP + "SELECT {place} rank, session_key, byte_offset, role, round(score, 6) AS score FROM top WHERE rank <= 10"


def _hits(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*more, "rank", "session_key", "byte_offset", "role", F.round("score", 6).alias("score"))


@query(_HITS.replace("{place}", ""))
def bm25_topk(spark, sf_dir):
    return _hits(S.search(blocks(spark, sf_dir), ASKED))


@query(f"WITH {_PLAIN} SELECT row_id, round(score, 6) AS score FROM scores")
def bm25_all_scores(spark, sf_dir):
    return S.scores(blocks(spark, sf_dir), ASKED).select("row_id", F.round("score", 6).alias("score"))


_BY_ROLE = {"prose": "user", "tool_use": "assistant", "tool_result": "system"}


@query(f"WITH {_bm25({**{c: (f'CASE WHEN role = {chr(39)}{r}{chr(39)} THEN prose ELSE {chr(39)}{chr(39)} END', S.WEIGHTS[c]) for c, r in _BY_ROLE.items()}, 'paths': ('role', 3.0)})} SELECT row_id, round(score, 6) AS score FROM scores")
def bm25_fielded(spark, sf_dir):
    rows = blocks(spark, sf_dir)
    fields = {c: F.when(F.col("role") == r, F.col("prose")).otherwise("") for c, r in _BY_ROLE.items()}
    return S.scores(rows.withColumns({**fields, "paths": F.col("role")}), ASKED).select("row_id", F.round("score", 6).alias("score"))


@query(f"WITH b AS ({CONV_DUCK}), tok AS (SELECT row_id, {_tokens('prose')} AS t FROM b), h AS (SELECT row_id, len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' AND t[i + 1] = 'the')) AS tf FROM tok) SELECT row_id, tf FROM h WHERE tf > 0")
def bm25_phrase(spark, sf_dir):
    got = S.phrase_hits(S.postings(blocks(spark, sf_dir), ["of", "the"]), [["of", "the"]])
    return got.groupBy("row_id").agg(F.sum("tf").alias("tf"))


@query(f"WITH {_PLAIN}, g AS (SELECT turn_id, score, row_id, 0 AS generation FROM scores JOIN b USING (row_id) UNION ALL SELECT turn_id, score, row_id, 1 FROM scores JOIN b USING (row_id) WHERE seq % 2 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY turn_id ORDER BY score, generation DESC) AS rn FROM g) SELECT turn_id, generation, round(score, 6) AS score FROM r WHERE rn = 1")
def best_block_per_turn(spark, sf_dir):
    rows = blocks(spark, sf_dir)
    scored = S.scores(rows, ASKED).join(rows, "row_id")
    again = scored.where("seq % 2 = 0").withColumn("generation", F.lit(1))
    return S.best_blocks(scored.unionByName(again)).select("turn_id", "generation", F.round("score", 6).alias("score"))


_AT = "try_cast(replace(replace(ts, 'T', ' '), 'Z', '') AS TIMESTAMP)"


@query(_TOP + f"SELECT row_number() OVER (ORDER BY {_AT} DESC NULLS LAST, rank) AS place, rank, session_key, byte_offset, role, round(score, 6) AS score FROM top WHERE rank <= 10")
def policy_latest(spark, sf_dir):
    return _hits(S.latest(S.search(blocks(spark, sf_dir), ASKED)), "place")


@query(_TOP + f"SELECT row_number() OVER (ORDER BY role = 'user' DESC, {_AT} DESC NULLS LAST, rank) AS place, rank, session_key, byte_offset, role, round(score, 6) AS score FROM top WHERE rank <= 10")
def policy_latest_user(spark, sf_dir):
    return _hits(S.latest_user(S.search(blocks(spark, sf_dir), ASKED)), "place")


@query(_HITS.replace("{place}", "rank AS place,"))
def policy_relevance(spark, sf_dir):
    return _hits(S.relevance(S.search(blocks(spark, sf_dir), ASKED)), "place")


@query(_TOP + "SELECT rank AS place, rank, session_key, byte_offset, replace(ts, ':00Z', 'Z') AS \"at\", substr(trim(regexp_replace(prose, '\\s+', ' ', 'g')), 1, 160) AS line FROM top WHERE rank <= 10")
def recall_lines(spark, sf_dir):
    return S.recall(blocks(spark, sf_dir), ASKED, policy="relevance")


# Views

_GEN = GENERATIONS.replace("{t}", "orders")
_USE = f"u AS ({USAGE_DUCK})"
_OK = "usage <> '{}' AND request_id IS NOT NULL AND role = 'assistant' AND COALESCE(model, '') <> '<synthetic>'"
_N = ", ".join(f"COALESCE(try_cast(regexp_extract(usage, '\"{n}\": ([0-9]+)', 1) AS BIGINT), 0) AS {n}" for n in views.TOKENS)
_REQ = f"{_USE}, l AS (SELECT *, row_number() OVER (PARTITION BY agent, request_id ORDER BY generation DESC, seq DESC) AS rn FROM u WHERE {_OK}), r AS (SELECT agent, request_id, session_key, generation, seq, model, {_N} FROM l WHERE rn = 1)"


@query(f"SELECT agent, count(DISTINCT session_id) AS sessions, count(*) AS generations, CAST(sum(turns) AS BIGINT) AS turns, CAST(sum(blocks) AS BIGINT) AS blocks, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(compactions) AS BIGINT) AS compactions, CAST(sum(1 - CAST(parsed AS INT)) AS BIGINT) AS unparsed FROM ({_GEN}) GROUP BY agent")
def dash_corpus(spark, sf_dir):
    return views.corpus(mapped(spark, sf_dir, "orders", GENERATIONS))


@query(f"WITH {_USE}, t AS (SELECT *, try_cast(CASE WHEN regexp_matches(ts, '^[0-9]{{4}}-') THEN replace(replace(ts, 'T', ' '), '+02:00', '') END AS TIMESTAMP) - INTERVAL 2 HOUR AS t0 FROM u) SELECT strftime(t0, '%Y-%m-%d') AS day, agent, count(*) AS turns, CAST(sum(byte_len) AS BIGINT) AS bytes FROM t WHERE t0 IS NOT NULL GROUP BY 1, 2")
def dash_growth(spark, sf_dir):
    return views.growth(usage(spark, sf_dir))


@query(f"SELECT agent, session_id, count(*) AS generations, CAST(sum(segments) AS BIGINT) AS segments, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(compactions) AS BIGINT) AS compactions, string_agg(skip_reason, ' | ' ORDER BY generation) AS skip_reasons FROM ({_GEN}) GROUP BY agent, session_id")
def dash_contiguity(spark, sf_dir):
    return views.contiguity(mapped(spark, sf_dir, "orders", GENERATIONS))


@query(f"WITH {_REQ} SELECT * FROM r")
def dash_requests(spark, sf_dir):
    return views.requests(usage(spark, sf_dir))


@query(f"WITH {_USE} SELECT agent, CASE WHEN request_id IS NULL THEN 'no request id' WHEN model = '<synthetic>' THEN 'synthetic model' ELSE 'not an assistant turn' END AS reason, count(*) AS turns, CAST(sum(COALESCE(try_cast(regexp_extract(usage, '\"output_tokens\": ([0-9]+)', 1) AS BIGINT), 0)) AS BIGINT) AS output_tokens FROM u WHERE usage <> '{{}}' AND NOT COALESCE({_OK}, FALSE) GROUP BY 1, 2")
def dash_unbilled(spark, sf_dir):
    return views.unbilled(usage(spark, sf_dir))


_SUMS = ", ".join(f"CAST(sum({n}) AS BIGINT) AS {n}" for n in views.TOKENS)
_SPEND = f"{_REQ}, s AS (SELECT agent, model, count(*) AS requests, {_SUMS} FROM r GROUP BY agent, model)"


@query(f"WITH {_SPEND} SELECT *, CASE WHEN input_tokens + cache_creation_input_tokens + cache_read_input_tokens > 0 THEN round(100.0 * cache_read_input_tokens / (input_tokens + cache_creation_input_tokens + cache_read_input_tokens), 1) END AS cache_read_percent FROM s")
def dash_spend(spark, sf_dir):
    return views.spend(usage(spark, sf_dir))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in views.UNMEASURED) + ") t(measure, reason)")
def dash_unmeasured(spark, sf_dir):
    return views.unmeasured(spark)


@query("SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, max_by(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus FROM orders GROUP BY o_custkey")
def last_write_per_key(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    return views.last_write(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query(f"WITH {_SPEND}, p(prefix, i, o) AS (VALUES ('m0', 3.0, 15.0), ('m1', 0.25, 1.25)) SELECT agent, model, round((input_tokens * i + cache_creation_input_tokens * i * 1.25 + cache_read_input_tokens * i * 0.1 + output_tokens * o) / 1e6, 6) AS cost FROM s LEFT JOIN p ON model = prefix")
def cost_by_model(spark, sf_dir):
    prices = spark.createDataFrame([("m0", 3.0, 15.0), ("m1", 0.25, 1.25)], "prefix string, input double, output double")
    dated = views.spend(usage(spark, sf_dir)).withColumn("plain", F.col("model")).withColumn("model", F.concat("model", F.lit("-20250101")))
    return views.cost(dated, prices).select("agent", F.col("plain").alias("model"), F.round("cost", 6).alias("cost"))


@query(f"SELECT count(*) AS generations, CAST(sum(turns) AS BIGINT) AS turns, CAST(sum(blocks) AS BIGINT) AS blocks, count(skip_reason) AS skipped FROM ({_GEN})")
def store_stats(spark, sf_dir):
    return views.store_stats(mapped(spark, sf_dir, "orders", GENERATIONS))


@query(f"""WITH {_USE}, k AS (SELECT session_key, COALESCE('req:' || request_id, 'off:' || byte_offset) AS key, max_by(usage, byte_offset) AS usage FROM u WHERE usage <> '{{}}' GROUP BY 1, 2),
c AS (SELECT session_key, unnest(['input_tokens', 'cache_read_input_tokens', 'output_tokens']) AS counter, usage FROM k)
SELECT session_key, counter, CAST(sum(CAST(regexp_extract(usage, '"' || counter || '": ([0-9]+)', 1) AS BIGINT)) AS BIGINT) AS total FROM c GROUP BY 1, 2""")
def billable_usage(spark, sf_dir):
    return views.billable_usage(usage(spark, sf_dir))


# Store

_LAG = f"WITH s AS ({SEGMENTS_DUCK}), l AS (SELECT *, COALESCE(lag(\"end\") OVER (PARTITION BY key ORDER BY start, \"end\"), 0) AS cursor FROM s)"


@query(_LAG + " SELECT key, CASE WHEN start > cursor THEN 'hole' ELSE 'overlap' END AS \"check\", path || ': ' || start || ' where ' || cursor || ' was due' AS detail FROM l WHERE start <> cursor")
def tiling_gaps(spark, sf_dir):
    return store.tiling(segments(spark, sf_dir))


@query(f"WITH s AS ({SEGMENTS_DUCK}) SELECT key, count(*) AS segments, min(start) AS first, max(\"end\") AS last, CAST(sum(\"end\" - start) AS BIGINT) AS bytes FROM s GROUP BY key")
def coverage(spark, sf_dir):
    return segments(spark, sf_dir).groupBy("key").agg(F.count("*").alias("segments"), F.min("start").alias("first"), F.max("end").alias("last"), F.sum(F.col("end") - F.col("start")).alias("bytes"))


@query(f"WITH s AS ({SEGMENTS_DUCK}), m AS (SELECT 'k' || o_custkey AS key, CAST(sum(1 + o_orderkey % 97) AS BIGINT) AS size FROM orders GROUP BY 1), e AS (SELECT key, max_by(\"end\", (start, \"end\")) AS c FROM s GROUP BY key) SELECT m.key, 'size' AS \"check\", 'segments end at ' || COALESCE(c, 0) || ', declared are ' || size AS detail FROM m LEFT JOIN e USING (key) WHERE size <> COALESCE(c, 0)")
def size_check(spark, sf_dir):
    declared = table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("k"), "o_custkey").alias("key")).agg(F.sum(1 + F.col("o_orderkey") % 97).alias("size"))
    return store.sizes(segments(spark, sf_dir), declared)


_CHAIN = """SELECT 'a' AS agent, 's' || o_custkey AS session_id, 's' || o_custkey || '/' || o_orderkey AS key, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS BIGINT) AS generation,
 'm' || o_orderkey AS manifest_sha256, 'f' || o_orderkey AS file_sha256, lag('m' || o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pm, CASE WHEN o_orderkey % 11 = 0 THEN 'forged' ELSE lag('f' || o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) END AS prev_file_sha256, o_orderkey AS o FROM {t}"""
_CHAIN = f"SELECT agent, session_id, key, generation, manifest_sha256, file_sha256, CASE WHEN o % 7 = 0 THEN 'forged' ELSE pm END AS prev_manifest_sha256, prev_file_sha256 FROM ({_CHAIN}) WHERE o % 29 <> 0"


@query(f"""WITH m AS ({_CHAIN.replace('{t}', 'orders')}), j AS (SELECT m.*, b.manifest_sha256 AS wm, b.file_sha256 AS wf FROM m LEFT JOIN m b ON m.session_id = b.session_id AND m.generation = b.generation + 1),
c AS (SELECT key, CASE WHEN generation = 0 AND (prev_manifest_sha256 IS NOT NULL OR prev_file_sha256 IS NOT NULL) THEN 'ancestor of the first' WHEN generation > 0 AND wm IS NULL THEN 'ancestor missing'
WHEN generation > 0 AND wm IS DISTINCT FROM prev_manifest_sha256 THEN 'chain of manifests' WHEN generation > 0 AND wf IS DISTINCT FROM prev_file_sha256 THEN 'chain of files' END AS "check" FROM j)
SELECT key, "check", '' AS detail FROM c WHERE "check" IS NOT NULL""")
def chain_links(spark, sf_dir):
    return store.chain(mapped(spark, sf_dir, "orders", _CHAIN))


@query("SELECT regexp_extract(path, 'raw/(.+)/[^/]+$', 1) AS key, 'unrecorded file' AS \"check\", path AS detail FROM (SELECT 'raw/a/c' || o_custkey || '/o' || o_orderkey AS path, o_orderkey FROM orders) o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_linenumber > 3)")
def unrecorded_files(spark, sf_dir):
    path = F.concat(F.lit("raw/a/c"), "o_custkey", F.lit("/o"), "o_orderkey").alias("path")
    listed = table(spark, sf_dir, "orders").select(path, "o_orderkey")
    known = table(spark, sf_dir, "lineitem").where("l_linenumber > 3").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return store.unrecorded(listed.join(known, "o_orderkey").select("path"), listed)


@query("SELECT 'o' || l_orderkey AS key, list('p' || l_linenumber ORDER BY l_linenumber) AS paths FROM lineitem GROUP BY l_orderkey")
def segment_groups(spark, sf_dir):
    return store.segment_groups(table(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("key"), F.col("l_linenumber").alias("start"), F.concat(F.lit("p"), "l_linenumber").alias("path")))


@query("SELECT 'a' AS agent, 's' || o_custkey AS session_id, max(o_orderkey) AS generation, max_by(CAST(floor(o_totalprice) AS BIGINT), o_orderkey) AS size FROM orders GROUP BY o_custkey")
def live_generation(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.lit("a").alias("agent"), F.concat(F.lit("s"), "o_custkey").alias("session_id"), F.col("o_orderkey").alias("generation"), F.floor("o_totalprice").alias("size"), F.lit("").alias("key"))
    return store.live_generations(rows).drop("key")


# The bytes of a conversation are its texts with line feeds; requests ask over turns' cuts.
_CUT = f"WITH b AS ({CONV_DUCK}), w AS (SELECT session_key, string_agg(prose || chr(10), '' ORDER BY seq) AS whole FROM b GROUP BY session_key)"


@query(_CUT + ", r AS (SELECT DISTINCT session_key, byte_offset // 2 AS \"offset\" FROM b) SELECT session_key AS key, \"offset\", sha256(substr(encode(whole), \"offset\" + 1, 64)) AS digest FROM r JOIN w USING (session_key)".replace("substr(encode(whole), \"offset\" + 1, 64)", "encode(whole)[\"offset\" + 1:\"offset\" + 64]"))
def span_lookup(spark, sf_dir):
    rows = blocks(spark, sf_dir)
    parts = rows.select(F.col("session_key").alias("key"), F.col("row_id").cast("string").alias("path"), F.col("byte_offset").alias("start"), (F.col("byte_offset") + F.col("byte_len") + 1).alias("end"), F.concat("prose", F.lit("\n")).cast("binary").alias("content"))
    asked = rows.select(F.col("session_key").alias("key"), F.floor(F.col("byte_offset") / 2).alias("offset"), F.lit(64).alias("length")).distinct()
    return store.spans(asked, parts, parts).select("key", "offset", F.sha2("bytes", 256).alias("digest"))


@query("SELECT DISTINCT url AS path, regexp_replace(substr(regexp_replace(regexp_extract(url, '([^/]*?)(?:\\.[^./]*)?$', 1), '[^A-Za-z0-9._-]+', '-', 'g'), 1, 96), '^[^A-Za-z0-9]+', '') AS stem, substr(sha256(url), 1, 16) AS digest FROM pages")
def session_naming(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(F.col("url").alias("path")).distinct().withColumn("name", store.session_name(F.col("path")))
    stem = F.expr("substring(name, 1, length(name) - 17)")
    return rows.select("path", F.when((stem == "session") & ~F.col("path").contains("session"), "").otherwise(stem).alias("stem"), F.right("name", F.lit(16)).alias("digest"))


_SPANS = "SELECT user_id AS k, event_id * 3 AS start, event_id * 3 + event_id % 400 + 1 AS \"end\" FROM events"


@query(f'WITH s AS ({_SPANS}), a AS (SELECT *, max("end") OVER (PARTITION BY k ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM s), i AS (SELECT *, sum(CASE WHEN e IS NULL OR start > e THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS g FROM a) SELECT k, min(start) AS start, max("end") AS "end" FROM i GROUP BY k, g')
def merge_spans(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return store.merge_spans(e.select(F.col("user_id").alias("k"), (F.col("event_id") * 3).alias("start"), (F.col("event_id") * 3 + F.col("event_id") % 400 + 1).alias("end")), ["k"])


@query("SELECT o_custkey, list_sort(list_distinct(list(b) FILTER (b >= 0 AND b <= 5000))) AS boundaries FROM (SELECT o_custkey, CAST(floor(o_totalprice) AS BIGINT) % 9000 - 500 AS b FROM orders) GROUP BY o_custkey HAVING count(*) FILTER (b >= 0 AND b <= 5000) > 0")
def boundary_clean(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.floor("o_totalprice") % 9000 - 500).alias("b"))
    return rows.select("o_custkey", store.clean_boundaries(F.col("b"), F.lit(5000)).alias("boundaries")).where(F.size("boundaries") > 0)


# Derivation

_MARKS = "SELECT 'u' || user_id AS session_id, event_id AS t0, event_type = 'error' AS mark FROM events"


@query(f"""WITH e AS ({_MARKS}), p AS (SELECT *, COALESCE(sum(CAST(mark AS INT)) OVER (PARTITION BY session_id ORDER BY t0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM e)
SELECT session_id, max(t0) FILTER (mark) AS mark, CASE WHEN bool_or(mark) THEN 'error' ELSE 'tail' END AS kind, count(*) FILTER (NOT mark) AS turns FROM p GROUP BY session_id, part""")
def timeline_spans(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id").alias("session_id"), F.col("event_id").alias("byte_offset"), F.col("event_type").alias("kind"))
    return derive.timeline(e.where("kind <> 'error'"), e.where("kind = 'error'"))


@query(f"WITH b AS ({CONV_DUCK}), e AS (SELECT role || '-' || (seq % 7) AS source, lead(role || '-' || (seq % 7)) OVER (PARTITION BY session_id ORDER BY byte_offset, seq) AS target FROM b) SELECT DISTINCT source, target FROM e WHERE target IS NOT NULL AND source <> target")
def succession_edges(spark, sf_dir):
    rows = blocks(spark, sf_dir).withColumn("ref", F.concat("role", F.lit("-"), F.col("seq") % 7))
    return derive.succession(rows, "session_id", ["byte_offset", "seq"], "ref")


@query(f"WITH {_USE} SELECT session_id, seq, last_value(model IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS model FROM u")
def carry_forward_model(spark, sf_dir):
    return derive.carried(usage(spark, sf_dir).select("session_id", "seq", "model"), "session_id", ["seq"], "model")


@query("SELECT doc_id, sha256(text) AS content_sha256 FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def dedup_first_by_offset(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_sha256"))
    return rows.groupBy("content_sha256").agg(F.min("doc_id").alias("doc_id"))


@query("SELECT source, reason, count(*) AS n FROM (SELECT source, CASE WHEN row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 THEN 'duplicate' WHEN length(text) < 100 THEN 'short' ELSE 'kept' END AS reason FROM documents) GROUP BY 1, 2")
def skip_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("h"), F.length("text").alias("n"))
    first = rows.groupBy("h").agg(F.min("doc_id").alias("first"))
    reason = F.when(F.col("doc_id") != F.col("first"), "duplicate").when(F.col("n") < 100, "short").otherwise("kept")
    return rows.join(first, "h").groupBy("source", reason.alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH {_USE} SELECT session_id, seq, row_number() OVER (PARTITION BY session_id ORDER BY byte_offset) - 1 AS place FROM u")
def dense_seq(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("session_id").orderBy("byte_offset")
    return usage(spark, sf_dir).select("session_id", "seq", (F.row_number().over(w) - 1).cast("bigint").alias("place"))


#: Conversations in which some turns are decisions by construction: the label is known.
_SPOKEN = """CASE WHEN role = 'user' AND n % 4 = 0 THEN 'Never use the w' || seq || ' library here.' WHEN role = 'user' AND n % 4 = 1 THEN 'As I said, never use the w' || seq || ' library.' WHEN role = 'user' AND n % 4 = 2 THEN 'Should we never use w' || seq || '?'
 WHEN role = 'assistant' AND n % 4 = 0 THEN 'Dropping w' || seq || '; let''s use a horse instead.' WHEN role = 'assistant' AND n % 4 = 1 THEN 'The horse w' || seq || ' works fine.' ELSE prose END"""
_LABEL = "CASE WHEN n % 4 = 0 AND role = 'user' THEN 'directive' WHEN n % 4 = 0 AND role = 'assistant' THEN 'reversal' END"
_NUMBERED = "CAST(floor(row_id / 1000000) AS BIGINT) AS n"


def _spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blocks(spark, sf_dir).selectExpr("*", _NUMBERED)
    return rows.withColumn("prose", F.expr(_SPOKEN)).withColumn("block_id", F.sha2(F.concat("role", "prose"), 256))


_SPOKEN_DUCK = f"WITH b AS (SELECT *, {_NUMBERED} FROM ({CONV_DUCK})), s AS (SELECT *, {_SPOKEN} AS said, {_LABEL} AS decision FROM b), d AS (SELECT session_key, byte_offset, sha256(role || said) AS block_id, decision FROM s WHERE decision IS NOT NULL)"


@query(f"{_SPOKEN_DUCK} SELECT * FROM d")
def decision_kinds(spark, sf_dir):
    return derive.decisions(_spoken(spark, sf_dir))


@query()
def lexrank_ideas(spark, sf_dir):
    return derive.ideas(blocks(spark, sf_dir).withColumn("block_id", F.col("turn_id")), 5)


@query(f"{_SPOKEN_DUCK}, r AS (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY session_key, byte_offset) AS rn FROM d) SELECT block_id, decision, session_key, byte_offset FROM r WHERE rn = 1")
def graph_nodes(spark, sf_dir):
    return derive.graph_nodes(decision_kinds(spark, sf_dir))


@query(f"{_SPOKEN_DUCK}, n AS (SELECT session_key, count(*) AS decisions FROM d GROUP BY 1) SELECT count(DISTINCT session_key) AS generations, CAST(0 AS BIGINT) AS marks, CAST((SELECT sum(decisions) FROM n) AS BIGINT) AS decisions FROM b")
def derive_stats(spark, sf_dir):
    rows = _spoken(spark, sf_dir)
    none = spark.createDataFrame([], "session_key string, byte_offset bigint, kind string")
    return derive.derive_stats(derive.artefacts(rows, rows, none)).select("generations", "marks", "decisions")


# Text

@query("SELECT doc_id, len(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')) AS sentences, strlen(text) AS bytes FROM documents")
def sentence_stats(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).cast("bigint").alias("sentences"), F.octet_length("text").cast("bigint").alias("bytes"))


@query("SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS word FROM documents) GROUP BY lang, word")
def word_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("lang", F.explode(T.words(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))


@query(f"SELECT term, count(*) AS n, count(DISTINCT conv_id) AS sessions FROM (SELECT conv_id, unnest({_tokens('text')}) AS term FROM conversations) GROUP BY term")
def token_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.explode(T.tokenize(F.col("text"))).alias("term"))
    return rows.groupBy("term").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("sessions"))


_PATH = T.PATH.replace("{1,255}+/){1,32}", "+/)+").replace("{1,255}", "+")


@query(f"SELECT page_id, list_distinct(regexp_extract_all(url, '{_PATH}')) AS paths FROM pages".replace("list_distinct", "list_sort(list_distinct").replace("')) AS", "'))) AS"))
def extract_paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_sort(T.paths(F.col("url"))).alias("paths"))


@query("SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '://([^/?#]+)', 1) AS host, regexp_extract(url, '://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(url, '\\?([^#]*)', 1) AS query FROM pages")
def url_parts(spark, sf_dir):
    part = lambda p, n: F.regexp_extract("url", p, 1).alias(n)
    return table(spark, sf_dir, "pages").select("page_id", part("^([a-z]+)://", "scheme"), part("://([^/?#]+)", "host"), part("://[^/?#]+([^?#]*)", "path"), part(r"\?([^#]*)", "query"))


@query("SELECT conv_id, turn, CASE WHEN length(text) <= 128 THEN text ELSE '…' || substr(text, 1, 110) || '-' || substr(sha256(text), 1, 16) END AS id FROM conversations")
def bounded_ids(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.bounded_id(F.col("text")).alias("id"))


@query("SELECT CASE WHEN ('0x' || right(sha256(CAST(doc_id AS VARCHAR)), 1))::INT % 2 = 0 THEN 'dev' ELSE 'test' END AS split, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM documents GROUP BY 1")
def split_by_hash(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy(T.split_of(F.col("doc_id").cast("string")).alias("split")).agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents), h AS (SELECT *, substr(t, 1, 119) AS h FROM f) SELECT doc_id, CASE WHEN t = '' THEN '(no visible text)' WHEN length(t) <= 120 THEN t ELSE rtrim(CASE WHEN contains(h, ' ') THEN regexp_extract(h, '^(.*) ', 1) ELSE h END) || '…' END AS label FROM h")
def graph_labels(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.label(F.col("text")).alias("label"))


# Secrets

_PLANTED = "text || ' ghp_' || substr(sha256('a' || doc_id), 1, 40) || CASE WHEN doc_id % 3 = 0 THEN ' AKIA' || upper(substr(sha256('b' || doc_id), 1, 16)) ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN ' postgres://u:p' || doc_id || '@h/x' ELSE '' END"
_FULL = [n for n in detectors.HIGH | detectors.SUSPECT if n != "assigned_secret"]
_COUNTED = ", ".join(f"""CAST(sum(len(regexp_extract_all(t, '{(detectors.HIGH | detectors.SUSPECT)[n].replace("'", "''")}'))) AS BIGINT) AS {n}""" for n in _FULL)


@query(f"SELECT source, {_COUNTED} FROM (SELECT source, {_PLANTED} AS t FROM documents) GROUP BY source")
def secret_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("t", F.expr(_PLANTED.replace("sha256('a' || doc_id)", "sha2('a' || doc_id, 256)").replace("sha256('b' || doc_id)", "sha2('b' || doc_id, 256)")))
    each = d.select("source", *detectors.counts(F.col("t")))
    return each.groupBy("source").agg(*(F.sum(n).alias(n) for n in _FULL))


@query()
def secret_findings(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc/"), "doc_id").alias("path"), F.expr(_PLANTED.replace("sha256('a' || doc_id)", "sha2('a' || doc_id, 256)").replace("sha256('b' || doc_id)", "sha2('b' || doc_id, 256)")).cast("binary").alias("content"))
    return detectors.scan(d)


@query(f"SELECT bool_and(n = 0) AS allowed FROM (SELECT len(regexp_extract_all(text, '{detectors.HIGH['github_token']}')) + len(regexp_extract_all(text, '{detectors.HIGH['aws_access_key_id']}')) AS n FROM documents)")
def egress_gate(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc/"), "doc_id").alias("path"), F.col("text").cast("binary").alias("content"))
    return spark.range(1).select(F.lit(detectors.gate(d.count(), detectors.scan(d))).alias("allowed"))


# Evaluation

_ASOF = f"WITH b AS ({CONV_DUCK})"


@query(_ASOF + ", p AS (SELECT session_key, byte_offset + (seq * 37) % 900 AS t0, row_id AS point FROM b) SELECT point, t0 AS \"at\", turn_id FROM p LEFT JOIN b ON p.session_key = b.session_key AND t0 >= byte_offset AND t0 < byte_offset + byte_len")
def asof_offset_to_turn(spark, sf_dir):
    b = blocks(spark, sf_dir)
    points = b.select("session_key", (F.col("byte_offset") + (F.col("seq") * 37) % 900).alias("at"), F.col("row_id").alias("point"))
    return evaluate.asof(points, b, "session_key", "at", "byte_offset", "byte_len", "turn_id").select("point", "at", "turn_id")


# Vectors ask for their neighbours: every one whose id is divisible by 20, against all.
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
_DOTS = {n: _DOT.replace("{a}", a).replace("{b}", b) for n, a, b in (("ab", "e", "embedding"), ("aa", "e", "e"), ("bb", "embedding", "embedding"))}
_COS = f"""WITH q AS (SELECT vec_id AS query, embedding AS e FROM embeddings WHERE vec_id % 20 = 0), c AS (SELECT query, vec_id AS item, round({_DOTS['ab']} / greatest(sqrt({_DOTS['aa']}) * sqrt({_DOTS['bb']}), 1e-9), 6) AS score,
round(sqrt(list_sum(list_transform(list_zip(e, embedding), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE))))), 6) AS far FROM q, embeddings WHERE query <> vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM c)"""


def _dense(spark: SparkSession, sf_dir: str, depth: int = 40, metric: str = "cosine") -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return evaluate.nearest(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", depth, metric)


@query(_COS + " SELECT query, item, rank, score FROM r WHERE rank <= 10")
def dense_topk(spark, sf_dir):
    return _dense(spark, sf_dir).where("rank <= 10").select("query", "item", "rank", "score")


_ARMS = _COS + ", a AS (SELECT query, item, rank FROM r WHERE rank <= 20), b AS (SELECT query, item, rank FROM (SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY far, item) AS rank FROM c) WHERE rank <= 20)"


def _arms(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Two rankings of the same items: by angle and by distance."""
    return [_dense(spark, sf_dir, 20, metric).select("query", "item", "rank") for metric in ("cosine", "distance")]


@query(_ARMS + ", f AS (SELECT query, item, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2) SELECT query, item, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY round(score, 12) DESC, item) AS rank FROM f")
def rrf_fusion(spark, sf_dir):
    return evaluate.fused(_arms(spark, sf_dir), "query", "item").select("query", "item", F.round("score", 6).alias("score"), "rank")


_GOLD = ", g AS (SELECT query, vec_id AS item FROM q JOIN embeddings e ON e.label = (query % 5) AND vec_id % 9 = query % 9)"
_METRICS = _COS + _GOLD + """, h AS (SELECT r.query, r.item, rank FROM r JOIN g ON r.query = g.query AND r.item = g.item WHERE rank <= 10), n AS (SELECT query, count(*) AS relevant FROM g GROUP BY query),
p AS (SELECT query, count(*) AS found, min(rank) AS first, sum(1.0::DOUBLE / log2({d})) AS dcg FROM h GROUP BY query),
m AS (SELECT n.query, relevant, COALESCE(found, 0) AS found, COALESCE(found, 0)::DOUBLE / relevant AS recall, CASE WHEN found > 0 THEN 1 ELSE 0 END AS hit, CASE WHEN found = relevant THEN 1 ELSE 0 END AS all_found, COALESCE(1.0::DOUBLE / first, 0) AS mrr, COALESCE(dcg, 0) / list_sum(list_transform(range(1, least(relevant, 10) + 1), lambda i: 1.0::DOUBLE / log2({i}))) AS ndcg FROM n LEFT JOIN p USING (query))"""
_ROUNDED = "query, relevant, found, round(recall, 6) AS recall, hit, all_found, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg"


def _metrics(spark: SparkSession, sf_dir: str, official: bool) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), (F.col("vec_id") % 5).alias("label"), (F.col("vec_id") % 9).alias("r"))
    gold = e.select(F.col("vec_id").alias("item"), "label", (F.col("vec_id") % 9).alias("r")).join(asked, ["label", "r"]).select("query", "item")
    return evaluate.ranking_metrics(_dense(spark, sf_dir), gold, "query", "item", 10, official)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("query", "relevant", "found", F.round("recall", 6).alias("recall"), "hit", "all_found", F.round("mrr", 6).alias("mrr"), F.round("ndcg", 6).alias("ndcg"))


@query(_METRICS.replace("{d}", "rank + 1").replace("{i}", "i + 1") + f" SELECT {_ROUNDED} FROM m")
def ir_metrics(spark, sf_dir):
    return _rounded(_metrics(spark, sf_dir, False))


@query(_METRICS.replace("{d}", "greatest(rank, 2)").replace("{i}", "greatest(i, 2)") + f" SELECT {_ROUNDED} FROM m")
def ndcg(spark, sf_dir):
    return _rounded(_metrics(spark, sf_dir, True))


@query("SELECT COALESCE(o_orderstatus, 'all') AS mode, COALESCE(o_orderpriority, 'all') AS arm, count(*) AS n, round(avg(CASE WHEN o_totalprice > 150000 THEN 1.0 ELSE 0.0 END), 6) AS hit FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())")
def metrics_grouping_sets(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    hit = F.round(F.avg(F.when(F.col("o_totalprice") > 150000, 1.0).otherwise(0.0)), 6)
    sets = o.groupingSets([["o_orderstatus", "o_orderpriority"], ["o_orderstatus"], []], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), hit.alias("hit"))
    return sets.select(F.coalesce("o_orderstatus", F.lit("all")).alias("mode"), F.coalesce("o_orderpriority", F.lit("all")).alias("arm"), "n", "hit")


_PRED = "SELECT quality, toxic, (doc_id * 7) % 5 > 0 AS good, doc_id % 6 = 0 AS bad FROM labels"


@query(f"""WITH l AS ({_PRED}), p AS (SELECT CAST(good AS BIGINT) AS q, CAST(bad AS BIGINT) AS t, count(*) AS predicted FROM l GROUP BY 1, 2), g AS (SELECT quality AS q, toxic AS t, count(*) AS gold FROM l GROUP BY 1, 2),
m AS (SELECT COALESCE(predicted, 0) AS predicted, COALESCE(gold, 0) AS gold, q FROM p FULL JOIN g USING (q, t))
SELECT q, CAST(sum(predicted) AS BIGINT) AS predicted, CAST(sum(gold) AS BIGINT) AS gold, CAST(sum(least(predicted, gold)) AS BIGINT) AS "right", round(sum(least(predicted, gold)) / sum(predicted), 6) AS "precision", round(sum(least(predicted, gold)) / sum(gold), 6) AS recall FROM m GROUP BY q""")
def precision_recall_multiset(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    said = labels.select(((F.col("doc_id") * 7) % 5 > 0).cast("bigint").alias("q"), (F.col("doc_id") % 6 == 0).cast("bigint").alias("t"))
    true = labels.select(F.col("quality").alias("q"), F.col("toxic").alias("t"))
    got = evaluate.precision_recall(evaluate.matched(said, true, ["q", "t"]), ["q"])
    return got.withColumn("precision", F.round("precision", 6)).withColumn("recall", F.round("recall", 6))


@query("""WITH h AS (SELECT item_id, text, item_id % 4 AS g, sha256(CAST(item_id AS VARCHAR)) AS k FROM benchmark)
SELECT g, item_id, sha256(COALESCE(lead(text) OVER (PARTITION BY g ORDER BY k), first_value(text) OVER (PARTITION BY g ORDER BY k))) AS other FROM h""")
def shuffled_arm(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").withColumn("g", F.col("item_id") % 4)
    return evaluate.deranged(b, "g", "item_id", "text").select("g", "item_id", F.sha2("other", 256).alias("other"))


@query(_TOP + ", w AS (SELECT session_key, max(byte_offset) FILTER (role = 'user') AS cut FROM b GROUP BY session_key) SELECT rank, top.session_key, byte_offset FROM top JOIN w USING (session_key) WHERE rank <= 40 AND byte_offset >= cut")
def live_window(spark, sf_dir):
    b = blocks(spark, sf_dir)
    cut = b.groupBy("session_key").agg(F.max(F.when(F.col("role") == "user", F.col("byte_offset"))).alias("cut"))
    return S.search(b, ASKED, 40).join(cut, "session_key").where("byte_offset >= cut").select("rank", "session_key", "byte_offset")


# Records

@query(f"WITH {_USE} SELECT session_id, arg_min(model, seq) FILTER (model IS NOT NULL) AS model, COALESCE(arg_min(request_id, seq) FILTER (request_id IS NOT NULL), session_id) AS first_request FROM u GROUP BY session_id")
def session_fallback(spark, sf_dir):
    at = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    return usage(spark, sf_dir).groupBy("session_id").agg(at("model").alias("model"), F.coalesce(at("request_id"), F.col("session_id")).alias("first_request"))


@query(f"WITH {_USE}, f AS (SELECT session_id, request_id, min(byte_offset) AS first_offset FROM u WHERE request_id IS NOT NULL GROUP BY 1, 2) SELECT u.session_id, seq, u.request_id, first_offset FROM u LEFT JOIN f ON u.session_id = f.session_id AND u.request_id = f.request_id")
def pointer_resolve(spark, sf_dir):
    u = usage(spark, sf_dir).select("session_id", "seq", "request_id", "byte_offset")
    first = u.where("request_id is not null").groupBy("session_id", "request_id").agg(F.min("byte_offset").alias("first_offset"))
    return u.drop("byte_offset").join(first, ["session_id", "request_id"], "left")


@query("SELECT event_id, COALESCE(regexp_extract(props, '\"k\": ?([0-9]+)', 1), '') AS k, CASE WHEN regexp_matches(props, '\"k\": ?[0-9]+') THEN 'number' ELSE 'other' END AS kind FROM events")
def type_guard(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(k, F.lit("")).alias("k"), F.when(k.rlike("^[0-9]+$"), "number").otherwise("other").alias("kind"))


@query("SELECT conv_id, turn, text || '\\x1b[2K\\u202e' AS safe FROM conversations")
def safe_text(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.safe_text(F.concat("text", F.lit("\x1b[2K\u202e"))).alias("safe"))


@query(f"WITH {_USE}, n AS (SELECT session_id, seq, agent, lead(seq) OVER (PARTITION BY session_id ORDER BY seq) AS next_seq, lead(role) OVER (PARTITION BY session_id ORDER BY seq) AS next_role FROM u) SELECT session_id, seq, next_seq FROM n WHERE agent = 'error' AND next_role = 'assistant'")
def post_failure_slice(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("session_id").orderBy("seq")
    rows = usage(spark, sf_dir).select("session_id", "seq", "agent", F.lead("seq").over(w).alias("next_seq"), F.lead("role").over(w).alias("next_role"))
    return rows.where("agent = 'error' and next_role = 'assistant'").select("session_id", "seq", "next_seq")


@query("SELECT COALESCE(lang, 'all') AS type, count(*) AS n, round(avg(CAST(quality AS DOUBLE)), 6) AS accuracy FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((lang), ())")
def qa_summary(spark, sf_dir):
    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return harness.qa_summary(both, "lang", F.col("quality")).withColumn("accuracy", F.round("accuracy", 6))


@query(f"""WITH l AS ({_PRED}), c AS (SELECT count(*) FILTER (good AND quality = 1) AS tp, count(*) FILTER (good AND quality = 0) AS fp, count(*) FILTER (NOT good AND quality = 1) AS fn, count(*) FILTER (good AND toxic = 1 AND quality = 0) AS toxic_fp FROM l)
SELECT *, round(CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp) END, 6) AS "precision", round(CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp / (tp + fn) END, 6) AS recall FROM c""")
def census_score(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select(F.lit(False).alias("aside"), (F.col("toxic") == 1).alias("machine"), F.when(F.col("quality") == 1, "good").alias("want"), F.when((F.col("doc_id") * 7) % 5 > 0, "good").alias("got"))
    got = harness.census_score(rows, "good")
    return got.select("tp", "fp", "fn", F.col("machine_fp").alias("toxic_fp"), F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(_COS + " SELECT CASE WHEN GROUPING(query) = 1 THEN -1 ELSE query END AS query, count(*) AS n, round(max(score), 6) AS best, round(avg(score), 6) AS mean FROM r WHERE rank <= 20 GROUP BY GROUPING SETS ((query), ())")
def arm_summary(spark, sf_dir):
    near = _dense(spark, sf_dir).where("rank <= 20")
    got = near.groupingSets([["query"], []], "query").agg(F.count("*").alias("n"), F.round(F.max("score"), 6).alias("best"), F.round(F.avg("score"), 6).alias("mean"))
    return got.select(F.coalesce("query", F.lit(-1).cast("bigint")).alias("query"), "n", "best", "mean")


@query(f"WITH {_USE} SELECT session_id, CAST(sum(COALESCE(try_cast(regexp_extract(usage, '\"output_tokens\": ([0-9]+)', 1) AS BIGINT), 0)) AS BIGINT) AS total FROM (SELECT session_id, max_by(usage, byte_offset) AS usage FROM u WHERE usage <> '{{}}' GROUP BY session_id, session_key, COALESCE('req:' || request_id, 'off:' || byte_offset)) GROUP BY session_id")
def rollup_usage(spark, sf_dir):
    u = usage(spark, sf_dir)
    owner = u.select("session_key", "session_id").distinct()
    got = views.billable_usage(u).where("counter = 'output_tokens'").join(owner, "session_key")
    return got.groupBy("session_id").agg(F.sum("total").alias("total"))


@query("SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_hourly(spark, sf_dir):
    """Events as a stream of files, counted by hour. Windows that a micro-batch changed are merged into the table by their key; the watermark lets the state of old ones go."""
    import uuid

    schema = table(spark, sf_dir, "events").schema
    place = f"{spark.sparkContext.getConf().get('spark.checkpoint.dir', None) or spark.conf.get('spark.sql.warehouse.dir')}/stream-{uuid.uuid4().hex}"
    # A pattern, as a stream takes no single file for its path.
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))
    hourly = rows.withWatermark("ts", "1 hour").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    hourly = hourly.select("event_type", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "n", "total")
    done = [-1]

    def merge(df: DataFrame, batch: int) -> None:
        # A version for each batch: one that runs twice writes the same one again.
        old = [k for k in done if k < batch][-1]
        if old >= 0:
            df = df.unionByName(spark.read.parquet(f"{place}/v{old}").join(df.select("event_type", "hour"), ["event_type", "hour"], "left_anti"))
        df.write.mode("overwrite").parquet(f"{place}/v{batch}")
        done.append(batch)

    hourly.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{place}/v{done[-1]}")
