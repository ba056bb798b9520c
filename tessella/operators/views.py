"""Views over generations, turns and blocks. In billing the last cumulative write of a request counts, in whichever generation or session it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.text import utc, utc_format

TOKENS = ("input_tokens", "cache_creation_input_tokens", "cache_read_input_tokens", "output_tokens")


def corpus(generations: DataFrame) -> DataFrame:
    return generations.groupBy("agent").agg(
        F.countDistinct("session_id").alias("sessions"), F.count("*").alias("generations"), F.sum("turns").alias("turns"), F.sum("blocks").alias("blocks"),
        F.sum("bytes").alias("bytes"), F.sum("compactions").alias("compactions"), F.sum(1 - F.col("parsed").cast("int")).alias("unparsed"),
    )


def growth(turns: DataFrame) -> DataFrame:
    """Turns and bytes by UTC day and agent; timestamps that can't be read are left out."""
    at = utc(F.col("ts"))
    return turns.withColumn("at", at).where("at is not null").groupBy(utc_format(F.col("at"), "yyyy-MM-dd").alias("day"), "agent").agg(F.count("*").alias("turns"), F.sum("byte_len").alias("bytes"))


def contiguity(generations: DataFrame) -> DataFrame:
    reasons = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("skip_reason").isNotNull(), F.struct("generation", "skip_reason")))), lambda s: s["skip_reason"]), " | ")
    return generations.groupBy("agent", "session_id").agg(
        F.count("*").alias("generations"), F.sum("segments").alias("segments"), F.sum("bytes").alias("bytes"), F.sum("compactions").alias("compactions"),
        F.when(F.count("skip_reason") > 0, reasons).alias("skip_reasons"),
    )


def _tokens(usage: Column, name: str) -> Column:
    """A whole number of the usage object; what isn't one counts as none."""
    return F.coalesce(F.get_json_object(usage, f"$.{name}").try_cast("bigint"), F.lit(0).cast("bigint"))


def _billable() -> Column:
    return (F.col("usage") != "{}") & F.col("request_id").isNotNull() & (F.col("role") == "assistant") & (F.coalesce("model", F.lit("")) != "<synthetic>")


def requests(turns: DataFrame) -> DataFrame:
    """One row for each billable request: its last write, by generation and then sequence."""
    order = F.struct("generation", "seq", "session_key")
    last = turns.where(_billable()).groupBy("agent", "request_id").agg(F.max_by(F.struct("session_key", "generation", "seq", "model", "usage"), order).alias("t"))
    return last.select("agent", "request_id", "t.session_key", "t.generation", "t.seq", "t.model", *(_tokens(F.col("t.usage"), n).alias(n) for n in TOKENS))


def unbilled(turns: DataFrame) -> DataFrame:
    reason = F.when(F.col("request_id").isNull(), "no request id").when(F.col("model") == "<synthetic>", "synthetic model").otherwise("not an assistant turn")
    rest = turns.where((F.col("usage") != "{}") & ~F.coalesce(_billable(), F.lit(False)))
    return rest.groupBy("agent", reason.alias("reason")).agg(F.count("*").alias("turns"), F.sum(_tokens(F.col("usage"), "output_tokens")).alias("output_tokens"))


def spend(turns: DataFrame) -> DataFrame:
    """Requests, tokens and the share of cache reads in input; the share of nothing is null."""
    sums = [F.sum(n).alias(n) for n in TOKENS]
    got = requests(turns).groupBy("agent", "model").agg(F.count("*").alias("requests"), *sums)
    read, into = F.col("cache_read_input_tokens"), F.col("input_tokens") + F.col("cache_creation_input_tokens") + F.col("cache_read_input_tokens")
    return got.withColumn("cache_read_percent", F.round(F.try_divide(F.lit(100.0) * read, into), 1))


UNMEASURED = (
    ("cost", "prices change and are not stored with the turns"),
    ("latency", "the log has no times of requests"),
    ("quality", "needs labels"),
    ("recall", "needs questions with known answers"),
    ("subscription", "the plan is not in the log"),
    ("tools", "side effects of tools are outside the log"),
)


def unmeasured(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(UNMEASURED, "measure string, reason string")


def last_write(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of each key the row that is last in order."""
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("r"))
    return last.select("r.*")


def cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage (model and TOKENS) with cost from prices (prefix, input, output in units for a million tokens): of the prefixes that the model has, bare or with a date, the longest; unknown models cost null.

    prices is a list of products; it is joined by its key, the model's name without a date.
    """
    name = F.regexp_replace("model", r"-\d{8}$", "")
    money = (
        F.col("input_tokens") * F.col("price_in") + F.col("cache_creation_input_tokens") * F.col("price_in") * 1.25 + F.col("cache_read_input_tokens") * F.col("price_in") * 0.1 + F.col("output_tokens") * F.col("price_out")
    ) / 1e6
    known = prices.select(F.col("prefix"), F.col("input").alias("price_in"), F.col("output").alias("price_out"))
    return usage.withColumn("prefix", name).join(known, "prefix", "left").withColumn("cost", F.when(money.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(float(1 << 53)), money)))).drop("prefix", "price_in", "price_out")


def store_stats(generations: DataFrame) -> DataFrame:
    return generations.agg(F.count("*").alias("generations"), F.coalesce(F.sum("turns"), F.lit(0)).alias("turns"), F.coalesce(F.sum("blocks"), F.lit(0)).alias("blocks"), F.count("skip_reason").alias("skipped"))


def billable_usage(turns: DataFrame) -> DataFrame:
    """Sums of all usage counters by session: of each request, id or offset (in this order of preference) the last write."""
    key = F.coalesce(F.concat(F.lit("req:"), "request_id"), F.concat(F.lit("uuid:"), "uuid"), F.concat(F.lit("off:"), F.col("byte_offset").cast("string")))
    last = turns.where("usage <> '{}'").groupBy("session_key", key.alias("key")).agg(F.max_by("usage", F.struct("byte_offset")).alias("usage"))
    pairs = last.select("session_key", F.explode(F.from_json("usage", "map<string,string>")).alias("counter", "value"))
    return pairs.withColumn("n", F.expr("try_cast(value as bigint)")).where("n is not null").groupBy("session_key", "counter").agg(F.sum("n").alias("total"))


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
