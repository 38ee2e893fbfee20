"""Time-series queries over samples (metric, labels..., ts, value), and sustained-condition alerts.

A window at `at` is (at - length, at]. A rate adds the positive steps of a series,
a fall being a reset that counts with its new value, over the window's length; a
series with fewer than two samples has none. Grids take the latest sample not
older than the lookback.

What a sample needs of its neighbours in the series is found within a stretch of time
(a day, or a part of the window or range), and the last or first sample of the nearest
other stretch is joined to its edge, so a long series is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemill.functions.measures import clamp_min
from telemill.functions.text import full_match

LOOKBACK = 300


def at_time(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def within(samples: DataFrame, at: str, secs: int) -> DataFrame:
    t = at_time(at)
    return samples.filter((F.col("ts") > t - F.make_dt_interval(secs=F.lit(secs))) & (F.col("ts") <= t))


#: Stretches that a window or range of samples is cut into.
STRETCHES = 96


def _stretch(start: Column, end: Column) -> Column:
    """The number of the stretch of (start, end], microseconds, that a sample lies in."""
    return F.floor((F.unix_micros("ts") - start) * STRETCHES / (end - start))


def beside(samples: DataFrame, keys: tuple[str, ...], columns: tuple[str, ...], later: bool = False, stretch: Column | None = None) -> DataFrame:
    """samples with `_near`: a struct of the columns of the sample before (or after) in the series, null if there is none.

    Samples of the same time are in order of their values, so that a counter does not fall
    between them. `stretch` grows with time: what is worked on at once, else a day.
    """
    d = samples.withColumn("_cell", F.struct(*keys, (F.to_date("ts") if stretch is None else stretch).alias("_day")))  # never null itself, so that it joins
    own = F.struct(*columns)
    edge = (F.min_by if later else F.max_by)(own, F.struct("ts", "value"))
    days = d.groupBy("_cell").agg(edge.alias("_edge"))
    day = F.col("_cell._day")
    series = Window.partitionBy(*[f"_cell.{k}" for k in keys]).orderBy(day.desc() if later else day.asc())
    days = days.withColumn("_edge", F.lag("_edge").over(series))
    inside = Window.partitionBy("_cell").orderBy(*[F.desc(c) if later else F.asc(c) for c in ("ts", "value")])
    near = F.lag(own).over(inside)
    return d.join(days, "_cell").withColumn("_near", F.coalesce(near, "_edge")).drop("_cell", "_edge")


def _step() -> Column:
    """What a counter grew by since the sample before; a fall is a reset."""
    return F.when(F.col("value") < F.col("_near.value"), F.col("value")).otherwise(F.col("value") - F.col("_near.value"))


def instant(samples: DataFrame, at: str, keys: tuple[str, ...], lookback: int = LOOKBACK) -> DataFrame:
    """Latest value a series."""
    return within(samples, at, lookback).groupBy(*keys).agg(F.max_by("value", "ts").alias("value"))


def rate(samples: DataFrame, at: str, secs: int, keys: tuple[str, ...]) -> DataFrame:
    t = F.unix_micros(at_time(at))
    s = beside(within(samples, at, secs), keys, ("value",), stretch=_stretch(t - secs * 1_000_000, t)).withColumn("step", _step())
    return s.groupBy(*keys).agg((F.sum("step") / secs).alias("value"), F.count(F.lit(1)).alias("_n")).filter("_n >= 2").drop("_n")


def rate_grid(samples: DataFrame, start: str, end: str, step: int, secs: int, keys: tuple[str, ...]) -> DataFrame:
    """(keys, at, value): the rate on a step grid. Each step's samples are found by equi-assignment to the grid points whose window holds them."""
    s = samples.filter((F.col("ts") > at_time(start) - F.make_dt_interval(secs=F.lit(secs))) & (F.col("ts") <= at_time(end)))
    s = beside(s, keys, ("value", "ts"), stretch=_stretch(F.unix_micros(at_time(start)) - secs * 1_000_000, F.unix_micros(at_time(end)))).select(*keys, "ts", _step().alias("delta"), F.col("_near.ts").alias("before"))
    return grid_of_steps(s, start, end, step, secs, keys)


def grid_of_steps(steps: DataFrame, start: str, end: str, step: int, secs: int, keys: tuple[str, ...]) -> DataFrame:
    """The rate on a step grid from steps (keys, ts, before, delta) of each series."""
    t0, n = F.unix_micros(at_time(start)), F.lit(step * 1_000_000)
    first = F.greatest(F.lit(0), F.ceil((F.unix_micros("ts") - t0) / n).cast("bigint"))
    last = F.least(F.floor((F.unix_micros(at_time(end)) - t0) / n).cast("bigint"), F.ceil((F.unix_micros("ts") + secs * 1_000_000 - t0) / n).cast("bigint") - 1)
    s = steps.withColumns({"_a": first, "_b": last}).filter("_a <= _b").withColumn("k", F.explode(F.sequence("_a", "_b")))
    at = F.timestamp_micros(t0 + F.col("k") * n)
    inside = F.col("before") > F.col("at") - F.make_dt_interval(secs=F.lit(secs))
    g = s.withColumn("at", at).groupBy(*keys, "at").agg((F.coalesce(F.sum(F.when(inside, F.col("delta"))), F.lit(0.0)) / secs).alias("value"), F.count(F.lit(1)).alias("_n"))
    return g.filter("_n >= 2").drop("_n")


def step_grid(samples: DataFrame, start: str, end: str, step: int, keys: tuple[str, ...], lookback: int = LOOKBACK) -> DataFrame:
    """(keys, at, value): the latest sample at each grid point; an as-of lookup without a range join."""
    s = samples.filter((F.col("ts") > at_time(start) - F.make_dt_interval(secs=F.lit(lookback))) & (F.col("ts") <= at_time(end)))
    t0, n = F.unix_micros(at_time(start)), F.lit(step * 1_000_000)
    s = beside(s, keys, ("ts",), later=True, stretch=_stretch(t0 - lookback * 1_000_000, F.unix_micros(at_time(end))))
    first = F.greatest(F.lit(0), F.ceil((F.unix_micros("ts") - t0) / n).cast("bigint"))
    steps = F.floor((F.unix_micros(at_time(end)) - t0) / n).cast("bigint")
    stale = F.ceil((F.unix_micros("ts") + lookback * 1_000_000 - t0) / n).cast("bigint") - 1
    replaced = F.ceil((F.unix_micros("_near.ts") - t0) / n).cast("bigint") - 1
    s = s.withColumns({"_a": first, "_b": F.least(steps, stale, F.coalesce(replaced, steps))}).filter("_a <= _b")
    s = s.withColumn("k", F.explode(F.sequence("_a", "_b")))
    return s.select(*keys, F.timestamp_micros(t0 + F.col("k") * n).alias("at"), "value")


def sum_by(vector: DataFrame, *by: str) -> DataFrame:
    return vector.groupBy(*by).agg(F.sum("value").alias("value"))


def histogram_quantile(buckets: DataFrame, q: float, *by: str) -> DataFrame:
    """(by, value) from (by, le double, value cumulative): linear within the bucket that holds q, the last finite bound beyond it, null if empty."""
    w = Window.partitionBy(*by).orderBy("le")
    b = buckets.withColumns({"_low": F.coalesce(F.lag("le").over(w), F.lit(0.0)), "_below": F.coalesce(F.lag("value").over(w), F.lit(0.0)), "_total": F.max("value").over(Window.partitionBy(*by))})
    rank = q * F.col("_total")
    inside = F.col("_low") + (F.col("le") - F.col("_low")) * (rank - F.col("_below")) / F.nullif(F.col("value") - F.col("_below"), F.lit(0.0))
    v = F.when(F.col("_total") <= 0, None).when(F.col("le") == float("inf"), F.col("_low")).otherwise(F.coalesce(inside, F.col("le")))
    hit = b.filter((F.col("value") >= rank) | (F.col("_total") <= 0)).withColumn("_v", v)
    return hit.groupBy(*by).agg(F.min_by("_v", "le").alias("value"))


def matched(vector: DataFrame, **labels: tuple[str, str]) -> DataFrame:
    """Label matchers: name=(op, value) with =, !=, =~ and !~; regular expressions match whole values."""
    for name, (op, value) in labels.items():
        c = F.coalesce(F.col(name), F.lit(""))
        keep = {"=": c == value, "!=": c != value, "=~": full_match(c, value), "!~": ~full_match(c, value)}[op]
        vector = vector.filter(keep)
    return vector


def multi_select(vector: DataFrame, label: str, chosen: list[str] | None, needs_value: bool = False) -> DataFrame:
    """A dashboard variable: all (optionally only non-empty), or the chosen values."""
    if chosen is None:
        return vector.filter(F.coalesce(F.col(label), F.lit("")) != "") if needs_value else vector
    return vector.filter(F.col(label).isin(chosen))


def ratio(left: DataFrame, right: DataFrame, on: tuple[str, ...], floor: float | None = None) -> DataFrame:
    """One-to-one matching on labels, of which both sides may lack one; the divisor may have a floor."""
    j = left.withColumn("_on", F.struct(*on)).join(right.select(F.struct(*on).alias("_on"), F.col("value").alias("_d")), "_on")
    d = clamp_min(F.col("_d"), floor) if floor is not None else F.nullif(F.col("_d"), F.lit(0.0))
    return j.select(*on, (F.col("value") / d).alias("value"))


def error_ratio(rates: DataFrame, floor: float = 0.001, *by: str) -> DataFrame:
    """Share of non-2xx in (by, status, value) rates, with a floor under the total."""
    bad = F.sum(F.when(~full_match(F.col("status"), "2.."), F.col("value")).otherwise(0.0))
    return rates.groupBy(*by).agg((bad / F.greatest(F.sum("value"), F.lit(floor))).alias("value"))


def outer_table(frames: dict[str, DataFrame], key: str) -> DataFrame:
    """Instant vectors side by side: one column a name. A tagged union and one aggregation by key instead of a chain of full outer joins."""
    names = list(frames)
    tagged = None
    for name, df in frames.items():
        one = df.select(key, F.lit(name).alias("_n"), F.col("value").alias("_v"))
        tagged = one if tagged is None else tagged.unionByName(one)
    return tagged.groupBy(key).agg(*[F.max(F.when(F.col("_n") == n, F.col("_v"))).alias(n) for n in names])


def also_in(vector: DataFrame, other: DataFrame, on: tuple[str, ...]) -> DataFrame:
    return vector.withColumn("_on", F.struct(*on)).join(other.select(F.struct(*on).alias("_on")), "_on", "left_semi").drop("_on")


def label_values(samples: DataFrame, label: str) -> DataFrame:
    return samples.select(label).distinct().orderBy(F.asc_nulls_first(label))


def last_not_null(series: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return series.groupBy(*keys).agg(F.max_by("value", F.when(F.col("value").isNotNull(), F.col("ts"))).alias("value"))


def flat_range(documents: DataFrame, column: str = "document") -> DataFrame:
    """(ts, value) of range-query results; values that are no finite numbers go."""
    from telemill.functions.measures import finite

    schema = "struct<status: string, data: struct<result: array<struct<values: array<array<string>>>>>>"
    d = documents.select(F.from_json(column, schema).alias("d")).filter("d.status = 'success'")
    v = d.select(F.explode("d.data.result").alias("r")).select(F.explode("r.values").alias("v"))
    s = v.select(F.get("v", F.lit(0)).try_cast("double").alias("ts"), F.get("v", F.lit(1)).try_cast("double").alias("value"))
    return s.filter(finite(F.col("value")))


def runs_of(conditions: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, since, until, samples): maximal runs of true `firing` samples in time order."""
    from telemill.sources.tables import running

    c = running(conditions.withColumn("_no", (~F.col("firing")).cast("int")), "_no", keys, ("ts",), F.to_date("ts")).withColumnRenamed("running", "_island")
    return c.filter("firing").groupBy(*keys, "_island").agg(F.min("ts").alias("since"), F.max("ts").alias("until"), F.count(F.lit(1)).alias("samples")).drop("_island")


def alerts(conditions: DataFrame, keys: tuple[str, ...], hold_seconds: int) -> DataFrame:
    """Runs that held for at least `hold_seconds`, with fired_at."""
    r = runs_of(conditions, keys)
    held = (F.unix_micros("until") - F.unix_micros("since")) >= hold_seconds * 1_000_000
    return r.filter(held).withColumn("fired_at", F.col("since") + F.make_dt_interval(secs=F.lit(hold_seconds)))


def firing_at(conditions: DataFrame, keys: tuple[str, ...], hold_seconds: int, at: str) -> DataFrame:
    """Series whose current run (up to `at`) has held long enough."""
    upto = conditions.filter(F.col("ts") <= at_time(at)).withColumn("_series", F.struct(*keys))
    last_no = F.max(F.when(~F.col("firing"), F.col("ts")))
    g = upto.groupBy("_series").agg(last_no.alias("_no"))
    first = upto.filter("firing").join(g, "_series").filter("_no is null or ts > _no").groupBy(*keys).agg(F.min("ts").alias("since"))
    return first.filter(F.unix_micros(at_time(at)) - F.unix_micros("since") >= hold_seconds * 1_000_000)
