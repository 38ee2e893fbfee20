"""Counters, gauges and cumulative histograms of finished requests, and their text exposition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemill.functions.measures import bucket_counts, queue_seconds, seconds
from telemill.functions.text import metric_label
from telemill.schemas import BUCKETS

MAX_MODELS = 32


def capped_models(finished: DataFrame, most: int = MAX_MODELS) -> DataFrame:
    """The first `most` models by finish_seq keep their names, the others become 'other'.

    Only the aggregated model list is ranked; it joins back by name.
    """
    first = finished.groupBy("model").agg(F.min("finish_seq").alias("_first"))
    named = first.orderBy("_first").limit(most).select(F.col("model").alias("_named"))
    return finished.join(named, F.col("model").eqNullSafe(F.col("_named")), "left").withColumn("model", F.coalesce("_named", F.lit("other"))).drop("_named")


def request_counts(finished: DataFrame) -> DataFrame:
    return finished.groupBy("model", "endpoint", F.col("status").cast("string").alias("status")).agg(F.count(F.lit(1)).alias("requests"))


def token_totals(finished: DataFrame) -> DataFrame:
    """Per-model sums; timing sums exist (are not null) only where a record has the key."""
    secs = lambda ns, has: F.sum(F.when(F.col(has), seconds(F.col(ns))))
    return finished.groupBy("model").agg(
        F.sum(F.coalesce("prompt_tokens", F.lit(0))).alias("prompt_tokens"),
        F.sum(F.coalesce("generated_tokens", F.lit(0))).alias("generated_tokens"),
        secs("prompt_ns", "has_prompt_ns").alias("prompt_seconds"),
        secs("eval_ns", "has_eval_ns").alias("eval_seconds"),
        secs("load_ns", "has_load_ns").alias("load_seconds"),
    )


def last_rates(finished: DataFrame) -> DataFrame:
    """Latest decode and prompt rates a model, of records with non-zero seconds."""

    def last(tokens, ns, has):
        ok = F.col(has) & (F.coalesce(F.col(ns), F.lit(0)) != 0)
        rate = F.coalesce(F.col(tokens), F.lit(0)) / seconds(F.when(ok, F.col(ns)))
        return F.max_by(F.when(ok, rate), F.when(ok, F.col("finish_seq")))

    return finished.groupBy("model").agg(last("generated_tokens", "eval_ns", "has_eval_ns").alias("last_decode"), last("prompt_tokens", "prompt_ns", "has_prompt_ns").alias("last_prompt"))


def with_queue(finished: DataFrame) -> DataFrame:
    return finished.withColumn("queue", queue_seconds(F.col("ttft"), F.col("load_ns"), F.col("prompt_ns"), F.col("has_load_ns"), F.col("has_prompt_ns")))


def histogram(finished: DataFrame, value: str, keys: tuple[str, ...] = ("model", "endpoint")) -> DataFrame:
    """(keys, le, count, total, sum): cumulative counts at each bound and +Inf; nulls are not observed."""
    g = finished.filter(F.col(value).isNotNull()).groupBy(*keys).agg(bucket_counts(F.col(value)).alias("b"), F.count(F.lit(1)).alias("total"), F.sum(value).alias("sum"))
    les = F.array(*[F.lit(f"{b:g}") for b in BUCKETS], F.lit("+Inf"))
    return g.select(*keys, F.inline(F.arrays_zip(les.alias("le"), F.concat("b", F.array("total")).alias("count"))), "total", "sum")


def active_over_time(inv: DataFrame) -> DataFrame:
    """(ts, active) after each start and finish: +1, -1, running sum.

    Days are summed first, so the running sum never puts all rows in one task.
    """
    ends = inv.filter("duration is not null").select((F.col("started") + F.col("duration")).alias("at"), F.lit(-1).alias("d"))
    e = inv.select(F.col("started").alias("at"), F.lit(1).alias("d")).unionByName(ends)
    e = e.groupBy("at").agg(F.sum("d").alias("d")).withColumn("day", F.floor(F.col("at") / 86400))
    days = e.groupBy("day").agg(F.sum("d").alias("n"))
    before = days.withColumn("base", F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)))
    inside = Window.partitionBy("day").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    e = e.join(before.select("day", "base"), "day").withColumn("active", (F.coalesce("base", F.lit(0)) + F.sum("d").over(inside)).cast("bigint"))
    return e.select("at", "active")


def active_now(inv: DataFrame) -> DataFrame:
    return inv.agg(F.count_if(F.col("state") == "running").alias("active"))


def exposition(series: DataFrame) -> DataFrame:
    """Text lines `name{labels} value` from (name, labels: array of (key, value), value: string), in order of name and labels."""
    return exposition_lines(series).orderBy("name", "labels").select("name", "line")


def exposition_lines(series: DataFrame) -> DataFrame:
    text = F.array_join(F.transform("labels", lambda x: F.concat(x["key"], F.lit('="'), metric_label(x["value"]), F.lit('"'))), ",")
    return series.withColumn("line", F.concat("name", F.when(F.size("labels") > 0, F.concat(F.lit("{"), text, F.lit("}"))).otherwise(""), F.lit(" "), "value"))


def general_number(value, digits: int = 9) -> Column:
    """Text of a double as C's %.{digits}g gives it: rounded to so many digits, without trailing zeros, with an exponent where it is under -4 or not under `digits`."""
    size = F.abs(value)
    mantissa = F.format_string(f"%.{digits - 1}e", size)  # d.dddde+xx, rounded
    power = F.split_part(mantissa, F.lit("e"), F.lit(2)).cast("int")
    bare = lambda t: F.when(F.contains(t, F.lit(".")), F.regexp_replace(t, r"\.?0+\z", "")).otherwise(t)
    plain = F.coalesce(*[F.when(power == p, bare(F.format_string(f"%.{digits - 1 - p}f", size))) for p in range(-4, digits)])
    raised = F.concat(bare(F.split_part(mantissa, F.lit("e"), F.lit(1))), F.lit("e"), F.split_part(mantissa, F.lit("e"), F.lit(2)))
    text = F.when(size == 0, "0").otherwise(F.coalesce(plain, raised))
    special = F.when(F.isnan(value), "nan").when(value == float("inf"), "inf").when(value == float("-inf"), "-inf")
    return F.coalesce(special, F.concat(F.when(value.cast("string").startswith("-"), "-").otherwise(""), text))


def _pair(name: str, value: Column | None = None) -> Column:
    return F.struct(F.lit(name).alias("key"), (F.col(name) if value is None else value).cast("string").alias("value"))


def _number(df: DataFrame, value: str) -> Column:
    return general_number(F.col(value)) if dict(df.dtypes)[value] == "double" else F.col(value).cast("string")


def series(df: DataFrame, value: str, *labels: str) -> DataFrame:
    """(suffix, labels, order, value) of a counter or gauge from (labels..., value)."""
    own = F.array(*[_pair(x) for x in labels]) if labels else F.expr("cast(array() as array<struct<key: string, value: string>>)")
    return df.select(F.lit("").alias("suffix"), own.alias("labels"), F.lit(0).alias("order"), _number(df, value).alias("value"))


def histogram_series(h: DataFrame, *labels: str) -> DataFrame:
    """The bucket, sum and count series of a histogram(); buckets in order of their bounds, then the sum, then the count."""
    own = [_pair(x) for x in labels]
    place = F.array_position(F.array(*[F.lit(f"{b:g}") for b in BUCKETS], F.lit("+Inf")), F.col("le")).cast("int")
    buckets = h.select(F.lit("_bucket").alias("suffix"), F.array(*own, _pair("le")).alias("labels"), place.alias("order"), F.col("count").cast("string").alias("value"))
    last = len(BUCKETS) + 2
    ends = h.filter("le = '+Inf'").select(F.inline(F.array(*[F.struct(F.lit(x).alias("suffix"), F.array(*own).alias("labels"), F.lit(last + i).alias("order"), v.alias("value")) for i, (x, v) in enumerate((("_sum", general_number(F.col("sum"))), ("_count", F.col("total").cast("string"))))])))
    return buckets.unionByName(ends)


def exposition_text(frames: dict[str, tuple[str, DataFrame]], help_lines: dict[str, str]) -> DataFrame:
    """(place, line) of a whole exposition from {name: (kind, series)}: for each metric its help and type, then its series by labels; histograms' buckets by bound."""
    out = None
    for i, (name, (kind, df)) in enumerate(frames.items()):
        head = ([f"# HELP {name} {help_lines[name]}"] if name in help_lines else []) + [f"# TYPE {name} {kind}"]
        own = exposition_lines(df.withColumn("name", F.concat(F.lit(name), "suffix")))
        key = F.transform(F.filter("labels", lambda x: x["key"] != "le"), lambda x: x["value"])
        body = own.select(F.struct(F.lit(i).alias("metric"), F.lit(1).alias("body"), key.alias("labels"), F.col("order")).alias("place"), "line")
        top = df.sparkSession.createDataFrame([(j, x) for j, x in enumerate(head)], "order int, line string")
        top = top.select(F.struct(F.lit(i).alias("metric"), F.lit(0).alias("body"), F.array().cast("array<string>").alias("labels"), F.col("order")).alias("place"), "line")
        both = top.unionByName(body)
        out = both if out is None else out.unionByName(both)
    return out.orderBy("place")


def request_series(finished: DataFrame, name: str = "ollama_requests_total") -> DataFrame:
    return series(request_counts(finished), "requests", "model", "endpoint", "status").withColumn("name", F.lit(name))


def request_log(inv: DataFrame) -> DataFrame:
    """One JSON text a request; unknown token counts are 0, durations have six decimals."""
    return inv.select(
        "id",
        F.to_json(
            F.struct(
                F.lit("ollama_request").alias("event"),
                F.col("id").alias("request_id"),
                "source",
                "purpose",
                "model",
                "endpoint",
                "status",
                F.round("duration", 6).alias("duration_seconds"),
                F.coalesce("prompt_tokens", F.lit(0)).alias("prompt_tokens"),
                F.coalesce("generated_tokens", F.lit(0)).alias("generated_tokens"),
            ),
            {"ignoreNullFields": "false"},
        ).alias("line"),
    )


def model_state(loaded: DataFrame) -> DataFrame:
    """(model, loaded, size_bytes, vram_bytes, context_length, offload_percent, full) of the loaded models (name, size, size_vram, context_length)."""
    from telemill.functions.measures import fully_offloaded, offload_percent

    size, vram = F.coalesce("size", F.lit(0)), F.coalesce("size_vram", F.lit(0))
    return loaded.select(F.col("name").alias("model"), F.lit(1).alias("loaded"), size.alias("size_bytes"), vram.alias("vram_bytes"), F.coalesce("context_length", F.lit(0)).alias("context_length"), offload_percent(vram, size).alias("offload_percent"), fully_offloaded(vram, size).alias("full"))
