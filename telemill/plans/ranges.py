"""Panels at each step of a range, and at an instant the two shapes that need several counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.plans.coverage import _one, dense
from telemill.plans.dashboards import evaluate, evaluate_range
from telemill.plans.queries import NOON, _panel, panel_samples, squeezed
from telemill.plans.registry import micros, query, r6
from telemill.plans.sql import SAMPLES
from telemill.sources import tables

START, STEP = "2024-01-15 11:40:00", 60
_NOW, _WIDE = f"epoch_us(TIMESTAMP '{NOON}')", 300_000_000
GRID = f"grid AS (SELECT epoch_us(TIMESTAMP '{START}') + {STEP * 1_000_000} * k AS g FROM (SELECT unnest(range(0, 21)) AS k))"
_DENSE = f"{_NOW} + CAST(floor((epoch_us(ts) - {_NOW}) / 144.0::DOUBLE) AS BIGINT)"
#: Rates of all counters at each time of the grid.
RATES = f"""{SAMPLES}, {GRID}, q AS (SELECT metric, instance, value, {_DENSE} AS t FROM samples),
  s AS (SELECT *, lag(value) OVER w AS p, lag(t) OVER w AS pt FROM q WINDOW w AS (PARTITION BY metric, instance ORDER BY t)),
  rates AS (SELECT g, metric, instance, coalesce(sum(CASE WHEN pt > g - {_WIDE} THEN CASE WHEN value < p THEN value ELSE value - p END END), 0) / 300 AS value
    FROM grid JOIN s ON t <= g AND t > g - {_WIDE} GROUP BY ALL HAVING count(*) >= 2)"""
#: Latest gauges at each time of the grid.
LATEST = f"""{GRID}, q AS (SELECT event_type AS metric, CAST(user_id % 3 AS VARCHAR) AS instance, value, {_DENSE} AS t FROM events),
  latest AS (SELECT g, metric, instance, arg_max(value, t) AS v FROM grid JOIN q ON t <= g AND t > g - {_WIDE} GROUP BY ALL)"""


def over(title: str, samples: DataFrame) -> DataFrame:
    return r6(micros(evaluate_range(_panel(title), samples, START, NOON, STEP), "at"), "value")


@query(f"""WITH {RATES} SELECT g AS "at", 'm' || instance AS model, round(sum(value), 6) AS value FROM rates GROUP BY g, instance""")
def pan_range_rate(spark, d):
    return over("Request rate by model", squeezed(panel_samples(spark, d)))


@query(f"""WITH {RATES} SELECT g AS "at", round(coalesce(sum(value) FILTER (metric = 'error'), 0) / greatest(sum(value), 0.001), 6) AS value FROM rates GROUP BY g""")
def pan_range_errors(spark, d):
    return over("Error share", squeezed(panel_samples(spark, d)))


_COUNTS = f"""{GRID}, e AS (SELECT user_id % 3 AS m, value, event_id, {_DENSE} AS t FROM events),
  b(le) AS (VALUES (0.1), (0.25), (0.5), (1), (2.5), (5), (10), (30), (60), (120), (300), ('infinity'::DOUBLE)),
  c AS (SELECT m, le::DOUBLE AS le, t, event_id, CAST(value <= le AS INT) AS hit FROM e, b),
  s AS (SELECT m, le, t, hit, lag(t) OVER (PARTITION BY m, le ORDER BY t, event_id) AS pt FROM c),
  h AS (SELECT g, m, le, CAST(coalesce(sum(CASE WHEN pt > g - {_WIDE} THEN hit END), 0) AS DOUBLE) / 300 AS c FROM grid JOIN s ON t <= g AND t > g - {_WIDE} GROUP BY ALL HAVING count(*) >= 2),
  l AS (SELECT g, m, le, c, coalesce(lag(le) OVER x, 0) AS lo, coalesce(lag(c) OVER x, 0) AS below, max(c) OVER (PARTITION BY g, m) AS total FROM h WINDOW x AS (PARTITION BY g, m ORDER BY le)),
  f AS (SELECT g, m, min(le) AS le FROM l WHERE c >= 0.95::DOUBLE * total OR total <= 0 GROUP BY g, m)"""


@query(f"""WITH {_COUNTS} SELECT g AS "at", 'm' || m AS model, round(CASE WHEN total <= 0 THEN NULL WHEN le = 'infinity'::DOUBLE THEN lo ELSE lo + (le - lo) * (0.95::DOUBLE * total - below) / (c - below) END, 6) AS value FROM l JOIN f USING (g, m, le)""")
def pan_range_p95(spark, d):
    b = squeezed(tables.bucket_samples(spark, d))
    le = F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.col("le").cast("string"))
    labels = F.create_map(F.lit("model"), F.concat(F.lit("m"), "instance"), F.lit("le"), le)
    return over("p95 duration by model", b.select(F.lit("ollama_request_duration_seconds_bucket").alias("metric"), labels.alias("labels"), "ts", "value"))


@query(f"""WITH {LATEST} SELECT a.g AS "at", round(a.v / greatest(b.v, 1), 6) AS value FROM latest a JOIN latest b USING (g, instance) WHERE a.metric = 'click' AND b.metric = 'view'""")
def pan_range_share(spark, d):
    return over("VRAM share", squeezed(panel_samples(spark, d)))


@query(f"""WITH {LATEST} SELECT g AS "at", round(sum(v) / greatest(count(*), 1), 6) AS value FROM latest WHERE metric IN ('click', 'view') GROUP BY g""")
def pan_range_up(spark, d):
    labels = F.create_map(F.lit("job"), F.col("metric"), F.lit("instance"), F.col("instance"))
    return over("Targets healthy", dense(spark, d, {"click": "up", "view": "up"}, labels))


@query(f"""WITH {LATEST} SELECT g AS "at", round(g / 1e6 - v, 6) AS value FROM latest WHERE metric = 'view'""")
def pan_range_age(spark, d):
    return over("Uptime", dense(spark, d, {"view": "node_boot_time_seconds"}, _one("host")))


@query(f"""WITH {LATEST}, n AS (SELECT g, greatest(count(*), 1) AS n FROM latest WHERE metric IN ('view', 'signup') GROUP BY g) SELECT g AS "at", round(v / n, 6) AS value FROM latest JOIN n USING (g) WHERE metric = 'click' AND instance = '1'""")
def pan_range_per_cpu(spark, d):
    labels = F.create_map(F.lit("cpu"), F.concat("metric", "instance"), F.lit("mode"), F.lit("idle"))
    s = dense(spark, d, {"click": "node_load1", "view": "node_cpu_seconds_total", "signup": "node_cpu_seconds_total"}, labels)
    return over("Load 1 a CPU", s.filter("metric <> 'node_load1' or labels['cpu'] = 'click1'"))


def _counters(spark, d, names: dict[str, str], labels) -> DataFrame:
    """Counters under the metric names that a panel asks for."""
    c = tables.counter_samples(spark, d).filter(F.col("metric").isin(*names))
    name = F.coalesce(*[F.when(F.col("metric") == k, v) for k, v in names.items()])
    return squeezed(c.select(name.alias("_name"), labels.alias("labels"), "ts", "value").withColumnRenamed("_name", "metric"))


def _idle(spark, d) -> DataFrame:
    """Idle seconds of three CPUs, among those of other modes."""
    mode = F.when(F.col("metric") == "view", "idle").otherwise("user")
    labels = F.create_map(F.lit("cpu"), F.col("instance"), F.lit("mode"), mode)
    return _counters(spark, d, {"view": "node_cpu_seconds_total", "click": "node_cpu_seconds_total"}, labels)


_IDLE_SQL = "round(1 - avg(value), 6) AS value FROM rates WHERE metric = 'view'"


@query(f"WITH {RATES} SELECT {_IDLE_SQL} AND g = {_NOW} HAVING count(*) > 0")
def pan_busy(spark, d):
    return r6(evaluate(_panel("Host CPU"), _idle(spark, d), NOON), "value")


@query(f"""WITH {RATES} SELECT g AS "at", {_IDLE_SQL} GROUP BY g""")
def pan_range_busy(spark, d):
    return over("Host CPU", _idle(spark, d))


def _costs(spark, d) -> DataFrame:
    """Load seconds and requests of three models; the sides' other labels differ."""
    labels = F.create_map(F.lit("model"), F.concat(F.lit("m"), "instance"), F.lit("side"), F.col("metric"))
    return _counters(spark, d, {"view": "ollama_model_load_seconds_total", "click": "ollama_requests_total", "error": "ollama_requests_total"}, labels)


_COST_SQL = """'m' || instance AS model, round(sum(value) FILTER (metric = 'view') / greatest(sum(value) FILTER (metric IN ('click', 'error')), 0.001), 6) AS value
  FROM rates WHERE metric IN ('view', 'click', 'error') {more} GROUP BY g, instance HAVING count(*) FILTER (metric = 'view') > 0 AND count(*) FILTER (metric <> 'view') > 0"""


@query(f"WITH {RATES} SELECT {_COST_SQL.format(more=f'AND g = {_NOW}')}")
def pan_load_cost(spark, d):
    return r6(evaluate(_panel("Load cost"), _costs(spark, d), NOON), "value")


@query(f"""WITH {RATES} SELECT g AS "at", {_COST_SQL.format(more="")}""")
def pan_range_load_cost(spark, d):
    return over("Load cost", _costs(spark, d))
