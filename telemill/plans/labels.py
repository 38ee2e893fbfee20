"""Queries over series that lack a label: null is a value like any other, and matches itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.operators import stats, timeseries
from telemill.plans.queries import AT, DAY, SERIES, rated
from telemill.plans.registry import micros, query
from telemill.plans.sql import GAUGES, RUNS, SAMPLES
from telemill.sources import tables

_LACK = "nullif(CAST(user_id % 3 AS VARCHAR), '1') AS instance"
_SAMPLES, _GAUGES = (s.replace("CAST(user_id % 3 AS VARCHAR) AS instance", _LACK) for s in (SAMPLES, GAUGES))
END = "2024-01-16 12:00:00"


def lacking(samples: DataFrame) -> DataFrame:
    """Series of instance 1 lack the label."""
    return samples.withColumn("instance", F.nullif("instance", F.lit("1")))


_STEPS = f"""{_SAMPLES}, w AS (SELECT metric, instance, CASE WHEN value < lag(value) OVER s THEN value ELSE value - lag(value) OVER s END AS step FROM samples WHERE {DAY} WINDOW s AS (PARTITION BY metric, instance ORDER BY ts)),
  rates AS (SELECT metric, instance, sum(step) / 86400 AS value FROM w GROUP BY metric, instance HAVING count(*) >= 2)"""


@query(f"WITH {_STEPS} SELECT metric, instance, round(value, 9) AS value FROM rates")
def ts_rate_null(spark, d):
    return timeseries.rate(lacking(tables.counter_samples(spark, d)), AT, 86400, SERIES).withColumn("value", F.round("value", 9))


@query(
    f"""WITH {_SAMPLES}, s AS (SELECT *, lag(value) OVER w AS p, lag(ts) OVER w AS pt FROM samples WHERE ts > TIMESTAMP '{AT}' - INTERVAL 21600 SECOND AND ts <= TIMESTAMP '{END}' WINDOW w AS (PARTITION BY metric, instance ORDER BY ts)),
    t AS (SELECT TIMESTAMP '{AT}' + INTERVAL 1 HOUR * k AS g FROM (SELECT unnest(range(0, 25)) AS k)),
    j AS (SELECT metric, instance, g, CASE WHEN pt > g - INTERVAL 21600 SECOND THEN CASE WHEN value < p THEN value ELSE value - p END ELSE 0 END AS d FROM t JOIN s ON ts <= g AND ts > g - INTERVAL 21600 SECOND)
    SELECT metric, instance, epoch_us(g) AS "at", round(coalesce(sum(d), 0) / 21600, 9) AS value FROM j GROUP BY ALL HAVING count(*) >= 2"""
)
def ts_rate_grid_null(spark, d):
    g = timeseries.rate_grid(lacking(tables.counter_samples(spark, d)), AT, END, 3600, 21600, SERIES)
    return micros(g, "at").withColumn("value", F.round("value", 9))


@query(
    f"""WITH {_GAUGES}, t AS (SELECT TIMESTAMP '{AT}' + INTERVAL 1 HOUR * k AS g FROM (SELECT unnest(range(0, 25)) AS k))
    SELECT metric, instance, epoch_us(g) AS "at", arg_max(value, ts) AS value FROM t JOIN samples ON ts <= g AND ts > g - INTERVAL 7200 SECOND GROUP BY ALL"""
)
def ts_step_grid_null(spark, d):
    return micros(timeseries.step_grid(lacking(tables.gauge_samples(spark, d)), AT, END, 3600, SERIES, 7200), "at")


_RUN = f"""{_GAUGES}, c AS (SELECT metric, instance, ts, value > 10 AS firing FROM samples), i AS (SELECT *, sum(CASE WHEN firing THEN 0 ELSE 1 END) OVER (PARTITION BY metric, instance ORDER BY ts) AS island FROM c),
  r AS (SELECT metric, instance, min(ts) AS since, max(ts) AS until, count(*) AS samples FROM i WHERE firing GROUP BY metric, instance, island)"""


def _conditions(spark, d) -> DataFrame:
    return lacking(tables.gauge_samples(spark, d)).withColumn("firing", F.col("value") > 10)


@query(f"WITH {_RUN} SELECT metric, instance, epoch_us(since) AS since, epoch_us(until) AS until, samples, epoch_us(since) + 7200000000 AS fired_at FROM r WHERE epoch_us(until) - epoch_us(since) >= 7200000000")
def al_null(spark, d):
    return micros(timeseries.alerts(_conditions(spark, d), SERIES, 7200), "since", "until", "fired_at")


@query(
    f"""WITH {_GAUGES}, c AS (SELECT metric, instance, ts, value > 10 AS firing FROM samples WHERE ts <= TIMESTAMP '{AT}'),
    n AS (SELECT *, max(CASE WHEN NOT firing THEN ts END) OVER (PARTITION BY metric, instance) AS no FROM c)
    SELECT metric, instance, epoch_us(min(ts)) AS since FROM n WHERE firing AND (no IS NULL OR ts > no) GROUP BY ALL HAVING epoch_us(TIMESTAMP '{AT}') - epoch_us(min(ts)) >= 1800000000"""
)
def al_firing_null(spark, d):
    return micros(timeseries.firing_at(_conditions(spark, d), SERIES, 1800, AT), "since")


@query(
    f"""WITH {_STEPS}, g AS (SELECT metric, instance, arg_max(value, ts) AS value FROM {_GAUGES.removeprefix("samples AS ")} WHERE {DAY} GROUP BY ALL)
    SELECT rates.metric, rates.instance, round(rates.value / nullif(g.value, 0), 9) AS value FROM rates JOIN g ON rates.metric = g.metric AND rates.instance IS NOT DISTINCT FROM g.instance"""
)
def ts_div_null(spark, d):
    rates = timeseries.rate(lacking(tables.counter_samples(spark, d)), AT, 86400, SERIES)
    last = timeseries.instant(lacking(tables.gauge_samples(spark, d)), AT, SERIES, 86400)
    return timeseries.ratio(rates, last, SERIES).withColumn("value", F.round("value", 9))


@query(
    f"""WITH {RUNS}, s AS (SELECT nullif(phase, 'view') AS phase, seq, output_tokens / decode_seconds AS v FROM runs WHERE decode_seconds > 0),
    h AS (SELECT phase, v, row_number() OVER (PARTITION BY phase ORDER BY seq) <= greatest(count(*) OVER (PARTITION BY phase) // 2, 1) AS head FROM s),
    g AS (SELECT phase, avg(v) FILTER (head) AS a, avg(v) FILTER (NOT head) AS b FROM h GROUP BY phase)
    SELECT phase, round((coalesce(b, a) - a) / nullif(a, 0) * 100, 4) AS drift_percent FROM g"""
)
def st_drift_null(spark, d):
    rows = rated(spark, d).withColumn("phase", F.nullif("phase", F.lit("view")))
    return stats.drift(rows, "decode_tokens_per_second", "seq", "phase").withColumn("drift_percent", F.round("drift_percent", 4))
