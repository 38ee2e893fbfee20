"""The driver tables, and bridge views that give `events` and `conversations` the shapes of the operators' inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))


def invocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The invocation history (schemas.INVOCATION) with finish_seq, the order in which requests finished."""
    i, kind = F.col("event_id"), F.col("event_type")
    state = F.when(kind == "error", "error").when(i % 97 == 0, "running").when(i % 89 == 0, "interrupted").otherwise("completed")
    e = _events(spark, sf_dir).withColumn("state", state)
    done = F.col("state").isin("completed", "error")
    return e.select(
        i.cast("string").alias("id"),
        (F.unix_micros("ts") / F.lit(1e6)).alias("started"),
        F.concat(F.lit("m"), (F.col("user_id") % 40).cast("string")).alias("model"),
        F.when(kind == "click", "/api/chat").when(kind == "purchase", "/v1/chat/completions").when(kind == "signup", "/api/embed").otherwise("/api/generate").alias("endpoint"),
        F.concat(F.lit("c"), (F.col("user_id") % 7).cast("string")).alias("source"),
        F.when(i % 5 == 0, "").otherwise(kind).alias("purpose"),
        "state",
        F.when(F.col("state") == "error", 499 + i % 2).when(F.col("state") == "completed", 200).cast("int").alias("status"),
        F.when(F.col("state") != "running", F.col("value")).alias("duration"),
        F.when((kind != "signup") & (i % 97 != 0), F.col("value") * 0.1).alias("ttft"),
        F.when(i % 11 != 0, F.col("k")).alias("prompt_tokens"),
        F.when(kind != "signup", i % 300).alias("generated_tokens"),
        F.col("props").alias("request"),
        F.when(done, F.concat(F.lit("answer "), F.col("props"))).alias("response"),
        (i % 13 == 0).alias("truncated"),
        F.when(F.col("state") == "error", "upstream failed").alias("error"),
        i.alias("finish_seq"),
    )


def running(df: DataFrame, value: str, keys: tuple[str, ...], order: tuple[str, ...], stretch) -> DataFrame:
    """df with `running`: the sum of a value so far in each series. Stretches of the order (such as days) are summed first, so that no series is one task; keys may be null, which is a series too."""
    return all_running(df, {"running": F.col(value)}, keys, order, stretch)


def all_running(df: DataFrame, values: dict[str, Column], keys: tuple[str, ...], order: tuple[str, ...], stretch) -> DataFrame:
    """df with a column a value: what `running` is, of several values of a row in one pass."""
    d = df.withColumn("_cell", F.struct(*keys, stretch.alias("_day")))  # never null itself, so that it joins
    days = d.groupBy("_cell").agg(F.struct(*[F.sum(v).alias(n) for n, v in values.items()]).alias("_sum"))
    before = Window.partitionBy(*[f"_cell.{k}" for k in keys]).orderBy("_cell._day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("_cell", F.struct(*[F.coalesce(F.sum(f"_sum.{n}").over(before), F.lit(0)).alias(n) for n in values]).alias("_base"))
    inside = Window.partitionBy("_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return d.join(days, "_cell").withColumns({n: F.col(f"_base.{n}") + F.sum(v).over(inside) for n, v in values.items()}).drop("_cell", "_base")


def counter_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters with genuine resets: (metric, instance, ts, value), two resets or so a series."""
    e = _events(spark, sf_dir).select(F.col("event_type").alias("metric"), (F.col("user_id") % 3).cast("string").alias("instance"), "ts", F.lit(1).alias("one"))
    return running(e, "one", ("metric", "instance"), ("ts",), F.to_date("ts")).select("metric", "instance", "ts", (F.col("running") % 250).cast("double").alias("value"))


def gauge_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gauges: (metric, instance, ts, value)."""
    return _events(spark, sf_dir).select(F.col("event_type").alias("metric"), (F.col("user_id") % 3).cast("string").alias("instance"), "ts", "value")


def bucket_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative latency buckets: (instance, le, ts, value), a sample an event and bound. The counts of all bounds run side by side in an event's row, which becomes samples afterwards."""
    from telemill.schemas import BUCKETS

    bounds = {f"_le{i}": b for i, b in enumerate((*BUCKETS, float("inf")))}
    e = _events(spark, sf_dir).select((F.col("user_id") % 3).cast("string").alias("instance"), "ts", "event_id", F.col("value").alias("_v"))
    e = all_running(e, {n: (F.col("_v") <= b).cast("int") for n, b in bounds.items()}, ("instance",), ("ts", "event_id"), F.date_trunc("hour", "ts"))
    x = F.explode(F.array(*[F.struct(F.lit(b).alias("le"), F.col(n).cast("double").alias("value")) for n, b in bounds.items()]))
    return e.select("instance", "ts", x.alias("x")).select("instance", "x.le", "ts", "x.value")


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ts, line, source, container, unit); docker lines have a container, journal lines a unit."""
    even = F.col("user_id") % 2 == 0
    return _events(spark, sf_dir).select(
        "ts",
        F.concat_ws(" ", "event_type", "props").alias("line"),
        F.when(even, "docker").otherwise("journal").alias("source"),
        F.when(even, F.concat(F.lit("svc"), (F.col("user_id") % 5).cast("string"))).alias("container"),
        F.when(~even, F.concat(F.lit("unit"), (F.col("user_id") % 3).cast("string"))).alias("unit"),
        F.col("event_id").alias("line_id"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark runs: (phase, seq, started, output_tokens, decode_seconds, wall_seconds, ttft, done_reason)."""
    e = running(_events(spark, sf_dir).withColumn("one", F.lit(1)), "one", ("event_type",), ("event_id",), F.floor(F.col("event_id") / 65536))
    return e.select(
        F.col("event_type").alias("phase"),
        F.col("running").cast("bigint").alias("seq"),
        (F.unix_micros("ts") / F.lit(1e6)).alias("started"),
        F.col("k").alias("prompt_tokens"),
        (F.col("event_id") % 300).alias("output_tokens"),
        F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("decode_seconds"),
        (F.col("value") * 1.25).alias("wall_seconds"),
        (F.col("value") * 0.1).alias("ttft"),
        F.when(F.col("event_id") % 13 == 0, "length").otherwise("stop").alias("done_reason"),
    )


def stream_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response streams (id, seq, line): assistant texts, one event a word with its blank, then a final record."""
    c = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    pieces = F.regexp_extract_all("text", F.lit(r"\s*\S+|\s+$"), F.lit(0))
    events = F.transform(pieces, lambda p: F.to_json(F.struct(p.alias("response"))))
    last = F.to_json(F.struct(F.lit(True).alias("done"), F.size(pieces).alias("eval_count"), F.lit(4).alias("prompt_eval_count")))
    lines = c.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.posexplode(F.concat(events, F.array(last))).alias("seq", "line"))
    return lines.withColumn("seq", F.col("seq").cast("bigint"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored answers from `benchmark`: (case_id, category, expected, actual), four spellings of the whole text in turn."""
    b = table(spark, sf_dir, "benchmark").withColumn("expected", F.btrim(F.translate("text", "\n\t", "  ")))
    x = F.col("expected")
    actual = (
        F.when(F.col("item_id") % 4 == 0, F.concat(F.lit("  Answer: "), x, F.lit(". ")))
        .when(F.col("item_id") % 4 == 1, F.concat(F.lit('"'), x, F.lit('"')))
        .when(F.col("item_id") % 4 == 2, F.concat(F.lit(" "), x, F.lit("\n")))
        .otherwise(F.concat(F.lit("no "), x))
    )
    return b.select(F.col("item_id").alias("case_id"), F.concat(F.lit("cat"), (F.col("item_id") % 3).cast("string")).alias("category"), "expected", actual.alias("actual"))
