"""Queries over keyed state: streams that stop and go on from their checkpoint, with rows out of order within the watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from telemill.operators import timeseries
from telemill.plans.queries import AT, SERIES
from telemill.plans.registry import micros, query
from telemill.plans.sql import GAUGES, INV, SAMPLES
from telemill.sources import tables
from telemill.sources.scratch import folder
from telemill.streaming import keyed, twins

END = "2024-01-16 12:00:00"
#: Seconds by which samples come out of order, and the watermark's delay in hours, twice that.
JITTER, LATE = 21600, 12
RUNS = 3


def _with(schema: StructType, name: str) -> StructType:
    return StructType([*schema.fields, StructField(name, IntegerType())])


def resumed(spark: SparkSession, rows: DataFrame, part, make: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """What a stream over the rows writes, with `batch`, if they come in RUNS parts (numbered by `part`) and the query stops after each and is started again from its checkpoint.

    Input, state and results are in the shared folder; a batch that is replayed replaces its rows.
    """
    home = folder(spark, "resumed")
    rows.withColumn("_part", F.greatest(F.lit(0), F.least(F.lit(RUNS - 1), part.cast("int")))).write.partitionBy("_part").parquet(f"{home}/parts")
    stored = spark.read.schema(_with(rows.schema, "_part")).parquet(f"{home}/parts")
    keyed.rocksdb(spark)
    schema = None
    for k in range(RUNS):
        stored.filter(F.col("_part") == k).drop("_part").write.mode("append").parquet(f"{home}/in")
        stream = make(twins.source(spark, f"{home}/in", rows.schema))
        schema = stream.schema
        write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{home}/rows/batch={number}")
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(_with(schema, "batch")).parquet(f"{home}/rows")


def _third(at, rows: DataFrame):
    """The number of the part of the time that a moment (seconds) falls into."""
    low, high = rows.agg(F.min(at), F.max(at)).first() or (0, 0)  # one row
    return F.floor((at - F.lit(low or 0)) * RUNS / F.lit(max(1, (high or 0) - (low or 0))))


def _jittered(ts) -> object:
    """Seconds of a moment, later by up to JITTER, by hash."""
    return F.unix_micros(ts) / 1_000_000 + F.pmod(F.xxhash64(ts), F.lit(JITTER))


@query(
    f"""WITH {INV}, e AS (SELECT max(CASE WHEN status IS NULL THEN started ELSE greatest(started, started + duration) END) - 3600 AS mark FROM inv)
    SELECT id, CASE WHEN status >= 400 THEN 'error' ELSE 'completed' END AS state, started, status FROM inv WHERE status IS NOT NULL
    UNION ALL SELECT id, 'interrupted', started, NULL FROM inv, e WHERE status IS NULL AND started + 21600 < mark"""
)
def str_lifecycle_timed(spark, d):
    """Requests without a finish for six hours end by a timer."""
    t = twins.transitions(tables.invocations(spark, d)).withColumn("ts", F.timestamp_micros(F.round(F.col("at") * 1_000_000).cast("long")))
    out = resumed(spark, t, _third(F.col("at"), t), lambda s: keyed.lifecycle(s, 21600))
    return out.select("id", "state", "started", "status")


@query("WITH l AS (SELECT user_id, string_agg(event_type || ' ' || props || chr(10), '' ORDER BY event_id) AS body FROM events GROUP BY user_id) SELECT CAST(user_id AS VARCHAR) AS id, left(body, 700) AS response, length(body) > 700 AS truncated FROM l")
def str_capture(spark, d):
    """The first 700 bytes of each user's lines, which come in any order."""
    lines = tables.table(spark, d, "events").select(F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("seq"), F.concat_ws(" ", "event_type", "props").alias("line"))
    out = resumed(spark, lines, F.pmod(F.xxhash64("seq"), F.lit(RUNS)), lambda s: keyed.capture(s, 700), "update")
    return out.groupBy("id").agg(F.max_by(F.struct("response", "truncated"), "batch").alias("x")).select("id", "x.*")


@query(
    f"""WITH {SAMPLES}, s AS (SELECT *, lag(value) OVER w AS p, lag(ts) OVER w AS pt FROM samples WHERE ts > TIMESTAMP '{AT}' - INTERVAL 21600 SECOND AND ts <= TIMESTAMP '{END}' WINDOW w AS (PARTITION BY metric, instance ORDER BY ts)),
    t AS (SELECT TIMESTAMP '{AT}' + INTERVAL 1 HOUR * k AS g FROM (SELECT unnest(range(0, 25)) AS k)),
    j AS (SELECT metric, instance, g, CASE WHEN pt > g - INTERVAL 21600 SECOND THEN CASE WHEN value < p THEN value ELSE value - p END ELSE 0 END AS d FROM t JOIN s ON ts <= g AND ts > g - INTERVAL 21600 SECOND)
    SELECT metric, instance, epoch_us(g) AS "at", round(coalesce(sum(d), 0) / 21600, 9) AS value FROM j GROUP BY ALL HAVING count(*) >= 2"""
)
def str_rate(spark, d):
    """Rates on a grid from a stream of counter samples; the last sample of a series, and with it a reset, is known over batches and restarts."""
    s = tables.counter_samples(spark, d)
    steps = resumed(spark, s, _third(_jittered("ts"), s), lambda x: keyed.counter_steps(x, SERIES, f"{LATE} hours"))
    return micros(timeseries.grid_of_steps(steps, AT, END, 3600, 21600, SERIES), "at").withColumn("value", F.round("value", 9))


HELD = f"""{GAUGES}, c AS (SELECT metric, instance, ts, value > 10 AS firing FROM samples), i AS (SELECT *, sum(CASE WHEN firing THEN 0 ELSE 1 END) OVER (PARTITION BY metric, instance ORDER BY ts) AS island,
    min(CASE WHEN NOT firing THEN ts END) OVER (PARTITION BY metric, instance ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS no FROM c),
  r AS (SELECT metric, instance, epoch_us(min(ts)) AS since, epoch_us(max(ts)) AS until, count(*) AS samples, epoch_us(min(no)) AS no FROM i WHERE firing GROUP BY metric, instance, island),
  e AS (SELECT epoch_us(max(ts)) - {LATE} * 3600000000 AS mark FROM samples)"""


def _states(spark, d) -> DataFrame:
    c = tables.gauge_samples(spark, d).select(*SERIES, "ts", (F.col("value") > 10).alias("firing"))
    return resumed(spark, c, _third(_jittered("ts"), c), lambda s: keyed.alert_states(s, SERIES, 7200, f"{LATE} hours"))


@query(f"WITH {HELD} SELECT metric, instance, since, until, samples, since + 7200000000 AS fired_at FROM r, e WHERE until - since >= 7200000000 AND no <= mark")
def str_alerts(spark, d):
    """The runs of al_for_duration that have ended, from a stream of samples."""
    r = _states(spark, d).filter("kind = 'resolved' and unix_micros(until) - unix_micros(since) >= 7200000000")
    return micros(r.select(*SERIES, "since", "until", "samples", (F.col("since") + F.expr("interval 2 hours")).alias("fired_at")), "since", "until", "fired_at")


@query(
    f"""WITH {HELD} SELECT metric, instance, 'pending' AS kind, since AS "at", since, NULL::BIGINT AS until, NULL::BIGINT AS samples FROM r, e WHERE since <= mark
    UNION ALL SELECT metric, instance, 'firing', since + 7200000000, since, NULL, NULL FROM r, e WHERE since + 7200000000 < mark AND (no IS NULL OR no - since >= 7200000000)
    UNION ALL SELECT metric, instance, CASE WHEN no - since >= 7200000000 THEN 'resolved' ELSE 'inactive' END, no, since, until, samples FROM r, e WHERE no <= mark"""
)
def str_alert_states(spark, d):
    """All changes of the alert's state; firing needs no sample at its time."""
    return micros(_states(spark, d).drop("batch"), "at", "since", "until")
