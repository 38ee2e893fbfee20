"""Benchmark statistics: distributions, drift, throughput, energy, accuracy, scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemill.functions.text import json_equal, normalized_answer, numeric_answer, stripped
from telemill.sources.scratch import folder


#: Half the width, in ranks, of the bracket in which an exact percentile is looked for at first; the sketch that gives it errs by a tenth of this.
BRACKET, ACCURACY = 0.001, 10_000
#: Values of a bracket that are put in order in one task; a bracket that holds more is cut into so many pieces, counted, and narrowed to those that matter.
IN_ORDER, PIECES = 10_000, 1024


def _sketched(rows: DataFrame, value: str, shares: dict[str, float], by: tuple[str, ...], also: tuple[Column, ...]) -> DataFrame:
    """A stored row a group: `also`, the number, least and greatest of the values, and a bracket of each share."""
    v = F.col(value).cast("double")
    edges = [min(1.0, max(0.0, q + d)) for q in shares.values() for d in (-BRACKET, BRACKET)]
    got = rows.groupBy(*by).agg(F.percentile_approx(v, edges, ACCURACY).alias("_e"), F.count(v).alias("_n"), F.min(v).alias("_least"), F.max(v).alias("_most"), *also)
    path = f"{folder(rows.sparkSession, 'sketch')}/groups"
    got.write.parquet(path)
    return rows.sparkSession.read.schema(got.schema).parquet(path)


def _among(values: DataFrame, brackets: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Values beside each bracket of their group, without those beyond it; null where a value lies below it."""
    same = F.lit(True)
    for b in by:
        same &= F.col(f"l.{b}").eqNullSafe(F.col(f"r.{b}"))
    lists = brackets.groupBy(*by).agg(F.collect_list(F.struct("_q", "_n", "_lo", "_hi")).alias("_x"))  # one a share
    j = values.alias("l").join(lists.alias("r"), same).select(*[F.col(f"l.{b}").alias(b) for b in by], "_v", F.inline("_x")).filter("_v <= _hi")
    return j.withColumn("_v", F.when(F.col("_v") >= F.col("_lo"), F.col("_v")))


def _ranks(qs: list[float]) -> tuple[Column, Column, Column]:
    """The two places in order that a share falls between, and how far it is from the first."""
    at = (F.col("_n") - 1) * F.element_at(F.array(*[F.lit(q) for q in qs]), F.col("_q") + 1)
    return F.floor(at), F.ceil(at), at - F.floor(at)


def _narrowed(values: DataFrame, brackets: DataFrame, by: tuple[str, ...], qs: list[float]) -> tuple[DataFrame, int]:
    """Brackets cut to the pieces that hold the two places, and the greatest number of values in one that still has different ones."""
    piece = F.when(F.col("_v").isNull(), -1).when(F.col("_hi") > F.col("_lo"), F.least(F.lit(PIECES - 1), F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * PIECES))).otherwise(0)
    counted = _among(values, brackets, by).groupBy(*by, "_q", "_n", piece.alias("_piece")).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
    upto = Window.partitionBy(*by, "_q").orderBy("_piece").rowsBetween(Window.unboundedPreceding, 0)
    counted = counted.withColumn("_upto", F.sum("_c").over(upto))  # over PIECES + 1 rows
    first, second, _ = _ranks(qs)
    begins = F.col("_upto") > first
    ends = F.col("_upto") - F.col("_c") <= second
    got = counted.filter(begins & ends & (F.col("_piece") >= 0)).groupBy(*by, "_q", "_n").agg(F.min("_a").alias("_lo"), F.max("_b").alias("_hi"), F.sum("_c").alias("_held"))
    path = f"{folder(values.sparkSession, 'bracket')}/groups"
    got.write.parquet(path)
    out = values.sparkSession.read.schema(got.schema).parquet(path)
    return out, out.agg(F.max(F.when(F.col("_lo") < F.col("_hi"), F.col("_held")))).first()[0] or 0  # one row


def percentiles(rows: DataFrame, value: str, shares: dict[str, float], *by: str, also: tuple[Column, ...] = ()) -> DataFrame:
    """(by, a column a share, and the aggregates `also`): exact percentiles, interpolated at (n - 1) * share, of the non-null values; null if there are none.

    A mergeable sketch brackets each. Brackets that may hold more values than one task
    should put in order are narrowed by counting, a scan a round, each a thousand times
    finer; then only the values in a bracket, counted by value, are put in order.
    """
    names, qs = list(shares), list(shares.values())
    values = rows.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    groups = _sketched(rows, value, shares, by, also)
    few = F.col("_n") * BRACKET < 4  # all of them
    each = [F.struct(F.lit(i).alias("_q"), F.when(few, F.col("_least")).otherwise(F.col("_e")[2 * i]).alias("_lo"), F.when(few, F.col("_most")).otherwise(F.col("_e")[2 * i + 1]).alias("_hi")) for i in range(len(qs))]
    brackets = groups.filter("_n > 0").select(*by, "_n", F.inline(F.array(*each)))
    held = (groups.agg(F.max("_n")).first()[0] or 0) * 2.2 * BRACKET  # one row
    while held > IN_ORDER:
        brackets, less = _narrowed(values, brackets, by, qs)
        if less >= held:  # few values, each many times
            break
        held = less
    counted = _among(values, brackets, by).groupBy(*by, "_q", "_n", "_v").agg(F.count(F.lit(1)).alias("_c"))  # what lies below a bracket is one row
    upto = Window.partitionBy(*by, "_q").orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, 0)
    counted = counted.withColumn("_upto", F.sum("_c").over(upto))
    first, second, part = _ranks(qs)
    at = lambda place: F.min(F.when(F.col("_upto") > place, F.col("_v")))
    got = counted.groupBy(*by, "_q").agg(at(first).alias("_a"), at(second).alias("_b"), F.max(part).alias("_f"))
    exact = got.withColumn("_x", F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f"))
    exact = exact.groupBy(*by).agg(*[F.max(F.when(F.col("_q") == i, F.col("_x"))).alias(n) for i, n in enumerate(names)])
    same = F.lit(True)
    for b in by:
        same &= F.col(f"l.{b}").eqNullSafe(F.col(f"r.{b}"))
    own = [F.col(f"l.{c}").alias(c) for c in groups.columns if c not in ("_e", "_n", "_least", "_most")]
    return groups.alias("l").join(exact.alias("r"), same, "left").select(*own, *names)


def summary(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """count, min, mean, median, p95, max, sample deviation and variation of the non-null values; nothing but the count if there are none."""
    v = F.col(value)
    sd, mean = F.stddev_samp(v), F.avg(v)
    plain = (F.count(v).alias("count"), F.min(v).alias("min"), mean.alias("mean"), F.max(v).alias("max"), sd.alias("standard_deviation"), (sd / F.nullif(mean, F.lit(0.0)) * 100).alias("coefficient_of_variation_percent"))
    got = percentiles(rows, value, {"median": 0.5, "p95": 0.95}, *by, also=plain)
    return got.select(*by, "count", "min", "mean", "median", "p95", "max", "standard_deviation", "coefficient_of_variation_percent")


def generation_summary(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum("prompt_tokens").alias("total_prompt_tokens"),
        F.sum("output_tokens").alias("total_output_tokens"),
        F.count_if(F.col("done_reason") == "length").alias("length_limited_requests"),
        F.sum("output_tokens").alias("_t"),
        (F.sum("output_tokens") / F.nullif(F.max(F.col("started") + F.col("wall_seconds")) - F.min("started"), F.lit(0.0))).alias("aggregate_output_tokens_per_second"),
        (F.count(F.lit(1)) / F.nullif(F.max(F.col("started") + F.col("wall_seconds")) - F.min("started"), F.lit(0.0))).alias("requests_per_second"),
    ).drop("_t")


def run_list(rows: DataFrame, order: str, fields: tuple[str, ...], *by: str, size: int = 100) -> DataFrame:
    """(by, page, runs): the runs of a summary as an array of structs in order, `size` numbers of the order a page."""
    page = F.floor((F.col(order) - 1) / size).alias("page")
    g = rows.groupBy(*by, page).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias("runs"))
    return g.select(*by, "page", "runs")


def drift(rows: DataFrame, speed: str, order: str, *by: str) -> DataFrame:
    """Percent change of mean speed from the first half (at least one) to the rest, in order, without nulls; one value: 0, none: null."""
    from telemill.sources.tables import running

    r = running(rows.withColumn("_one", F.col(speed).isNotNull().cast("int")), "_one", by, (order,), F.floor(F.col(order) / 65536)).withColumn("_by", F.struct(F.lit(0), *by))
    r = r.join(rows.groupBy(F.struct(F.lit(0), *by).alias("_by")).agg(F.count(speed).alias("_n")), "_by")
    head = F.col("running") <= F.greatest(F.floor(F.col("_n") / 2), F.lit(1))
    a, b = F.avg(F.when(head, F.col(speed))), F.avg(F.when(~head, F.col(speed)))
    return r.groupBy(*by).agg(((F.coalesce(b, a) - a) / F.nullif(a, F.lit(0.0)) * 100).alias("drift_percent"))


def energy(rows: DataFrame, power: str, at: str, *by: str) -> DataFrame:
    """Watt hours: mean power times the window."""
    return rows.groupBy(*by).agg((F.avg(power) * (F.max(at) - F.min(at)) / 3600).alias("energy_wh"))


def missing(values: DataFrame, wanted: list[str], name: str = "metric") -> DataFrame:
    """(metric, present) of a wanted list, whether or not it has values."""
    spark = values.sparkSession
    want = spark.createDataFrame([(w,) for w in wanted], f"{name} string")
    return want.join(values.select(name).distinct().withColumn("_p", F.lit(True)), name, "left").select(name, F.coalesce("_p", F.lit(False)).alias("present"))


def score(rows: DataFrame) -> DataFrame:
    """rows (scorer, expected, actual) with passed and detail; an unknown scorer fails the query."""
    e, a = F.col("expected"), F.col("actual")
    number, want = numeric_answer(a), e.try_cast("decimal(38,10)")
    same = json_equal(a, e)
    passed = (
        F.when(F.col("scorer") == "exact", stripped(a) == e)
        .when(F.col("scorer") == "normalized", normalized_answer(a) == normalized_answer(e))
        .when(F.col("scorer") == "number", F.coalesce(number == want, F.lit(False)))
        .when(F.col("scorer") == "json", F.coalesce(same, F.lit(False)))
        .otherwise(F.raise_error(F.concat(F.lit("unknown scorer: "), F.col("scorer"))).cast("boolean"))
    )
    detail = F.when((F.col("scorer") == "number") & number.isNull(), "response was not solely a numeric answer").when((F.col("scorer") == "json") & same.isNull(), "invalid JSON")
    return rows.withColumns({"passed": passed, "detail": detail})


def accuracy(scored: DataFrame) -> DataFrame:
    """passed, total and percent by category and overall (category null), in one pass."""
    return scored.rollup("category").agg(F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("total"), (F.count_if("passed") / F.count(F.lit(1)) * 100).alias("accuracy_percent"))


def context_cases(cases: DataFrame, context_length: int) -> DataFrame:
    """Admitted (seq, target, position, code) of (seq, words, position, code, fraction): targets of at least 128, each once, the first kept."""
    c = cases.withColumn("target", F.least("words", F.floor(context_length * F.col("fraction")).cast("int"))).filter("target >= 128")
    w = Window.partitionBy("target").orderBy("seq")
    return c.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("seq", "target", "position", "code")


#: Words that fill an archive, and the record hidden in it.
FILLER = ("river", "lantern", "meadow", "copper")
RECORD = ("REMARK", "HERE:", "the", "entry", "code", "is")
ASKED = "The archive that follows holds a single entry code. Read all of it and answer with that code.\n\n", "\n\nWhich entry code does the archive hold? Answer with the code alone."


def context_prompt(words: Column, position: Column, code: Column) -> Column:
    """A prompt of filler words with a record inserted at a share of them."""
    filler = F.array(*[F.lit(w) for w in FILLER])
    body = F.flatten(F.array_repeat(filler, F.ceil(F.greatest(words - 60, F.lit(1)) / len(FILLER)).cast("int")))
    at = F.floor(F.size(body) * position).cast("int")
    record = F.concat(F.array(*[F.lit(w) for w in RECORD]), F.array(code))
    whole = F.concat(F.slice(body, F.lit(1), at), record, F.slice(body, at + 1, F.size(body)))
    return F.concat(F.lit(ASKED[0]), F.array_join(whole, " "), F.lit(ASKED[1]))


def distributions(rows: DataFrame, fields: tuple[str, ...], *by: str) -> DataFrame:
    """(by, field, distribution...) of several fields together."""
    each = F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("_v")) for f in fields]))
    return summary(rows.select(*by, each), "_v", *by, "field")


def measured_cases(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """Cases joined to what was measured (case_id, actual) and scored; a case without an answer has failed."""
    scored = score(cases.join(answers, "case_id", "left"))
    return scored.withColumn("passed", F.coalesce("passed", F.lit(False)))


def rounded(df: DataFrame, digits: int = 3) -> DataFrame:
    """All doubles of a frame rounded; what is no number stays."""
    return df.withColumns({f.name: F.round(f.name, digits) for f in df.schema if f.dataType.simpleString() in ("double", "float")})


def report(sections: dict[str, DataFrame]) -> DataFrame:
    """(document): a JSON report of summary frames, rounded; each section's rows are those of a summary, a row a group."""
    out = None
    for name, df in sections.items():
        rows = rounded(df).agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(name))
        out = rows if out is None else out.crossJoin(rows)  # one-row frames
    return out.select(F.to_json(F.struct(*sections), {"ignoreNullFields": "false"}).alias("document"))


def headline(warm: DataFrame, sustained: DataFrame, cold: DataFrame, deployment: DataFrame, accuracy: DataFrame | None = None, context: DataFrame | None = None, concurrent: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """The twelve numbers of a report in a row, from one-row frames: null where a section is missing, and for a cold start unless the model was truly unloaded.

    warm and the second of concurrent: distributions; sustained: a generation summary
    with drift_percent; cold: load_seconds, wall_seconds, model_was_confirmed_unloaded.
    """
    confirmed = F.col("model_was_confirmed_unloaded")
    number = lambda df, value, name: df.agg(F.first(value).cast("double").alias(name))
    of = lambda df, field, value, name: df.agg(F.max(F.when(F.col("field") == field, F.col(value))).alias(name))
    none = lambda name: warm.sparkSession.range(1).select(F.lit(None).cast("double").alias(name))
    parts = [
        number(accuracy, "accuracy_percent", "functional_accuracy_percent") if accuracy is not None else none("functional_accuracy_percent"),
        number(context, "accuracy_percent", "context_retrieval_accuracy_percent") if context is not None else none("context_retrieval_accuracy_percent"),
        number(cold, F.when(confirmed, F.col("load_seconds")), "cold_model_load_seconds"),
        number(cold, F.when(confirmed, F.col("wall_seconds")), "cold_request_wall_seconds"),
        of(warm, "ttft", "median", "warm_time_to_first_token_median_seconds"),
        of(warm, "decode_tokens_per_second", "median", "warm_decode_tokens_per_second_median"),
        of(warm, "decode_tokens_per_second", "p95", "warm_decode_tokens_per_second_p95"),
        number(sustained, "aggregate_output_tokens_per_second", "sustained_aggregate_tokens_per_second"),
        number(sustained, "drift_percent", "sustained_decode_speed_drift_percent"),
        number(concurrent[0], "aggregate_output_tokens_per_second", "concurrent_aggregate_tokens_per_second") if concurrent else none("concurrent_aggregate_tokens_per_second"),
        of(concurrent[1], "wall_seconds", "p95", "concurrent_latency_p95_seconds") if concurrent else none("concurrent_latency_p95_seconds"),
        deployment.agg(F.first("full_gpu_offload").alias("full_gpu_offload")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one-row frames
    return out
