"""Structured Streaming twins of the batch operators, and the keyed request lifecycle."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from telemill.sources.scratch import folder

LIFECYCLE = "id string, state string, started double, finished double, status int"


def source(spark: SparkSession, glob: str, schema) -> DataFrame:
    """A stream over files that match a folder or glob."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(glob)


def request_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("model", "endpoint", F.col("status").cast("string").alias("status")).agg(F.count(F.lit(1)).alias("requests"))


def log_volume(lines: DataFrame, step_seconds: int, label: str, late_seconds: int) -> DataFrame:
    """(at, label, value) once a step is later than the watermark; lines later than that are dropped."""
    w = F.window("ts", f"{step_seconds} seconds")
    g = lines.withWatermark("ts", f"{late_seconds} seconds").groupBy(w, F.coalesce(F.col(label), F.lit("")).alias(label)).agg(F.count(F.lit(1)).alias("value"))
    return g.select(F.col("window.start").alias("at"), label, "value")


#: Groups that open requests are dealt to by a hash of their id: a group's rows are folded at once, as a call of Python a request costs a millisecond.
GROUPS = 1024
OPEN = "ids array<string>, started array<double>, seen array<long>"


def group_of(identifier: str = "id") -> Column:
    return F.pmod(F.xxhash64(identifier), F.lit(GROUPS)).cast("int")


def earlier(a: float, b: float) -> float:
    return b if a != a or b < a else a


def news(batches: Iterator[pd.DataFrame]) -> tuple[dict, dict]:
    """Of each id the first start, and (at, status) of the last finish: of those at the same time the last row, and one without a time comes last."""
    first, last = {}, {}
    for pdf in batches:
        for k, kind, at, status in zip(*[pdf[c].tolist() for c in ("id", "kind", "at", "status")], strict=True):
            if kind != "finish":
                first[k] = earlier(first.get(k, at), at)
            elif k not in last or at != at or at >= last[k][0]:
                last[k] = (at, None if status is None or status != status else int(status))
    return first, last


def terminal(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["id", "state", "started", "finished", "status"]).astype({"started": float, "finished": float, "status": "Int32"})


def ended(last: dict, first: dict) -> pd.DataFrame:
    """Terminal rows of finishes, whose starts may be unknown."""
    return terminal([(k, "error" if (status or 0) >= 400 else "completed", first.get(k), at, status) for k, (at, status) in last.items()])


def interrupted(opened: dict) -> pd.DataFrame:
    return terminal([(k, "interrupted", started, None, None) for k, started in opened.items()])


def _advance(limit_ms: int | None):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs() if limit_ms is not None else 0
        held = {k: (started, seen) for k, started, seen in zip(*state.get, strict=True)} if state.exists else {}
        if state.hasTimedOut:
            over = {k: x for k, x in held.items() if x[1] + limit_ms <= now}
            yield interrupted({k: x[0] for k, x in over.items()})
            held = {k: x for k, x in held.items() if k not in over}
        else:
            first, last = news(batches)
            for k, started in first.items():
                held[k] = (earlier(held.get(k, (started,))[0], started), now)
            if last:
                yield ended(last, {k: x[0] for k, x in held.items() if k in last})
            held = {k: x for k, x in held.items() if k not in last}
        if not held:
            if state.exists:
                state.remove()
            return
        state.update(tuple(map(list, zip(*[(k, *x) for k, x in held.items()], strict=True))))
        if limit_ms is not None:
            state.setTimeoutDuration(max(1, min(x[1] for x in held.values()) + limit_ms - now))

    return step


def lifecycle(transitions: DataFrame, limit_ms: int | None = None) -> DataFrame:
    """Rows (id, kind start or finish, at, status) to one terminal row a request; state holds only open requests, in GROUPS lists.

    With `limit_ms`, a request without an end for so long becomes interrupted;
    for a continuous trigger, as such a stream always has a next batch.
    """
    timeout = GroupStateTimeout.NoTimeout if limit_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return transitions.withColumn("_group", group_of()).groupBy("_group").applyInPandasWithState(_advance(limit_ms), LIFECYCLE, OPEN, "append", timeout)


def transitions(inv: DataFrame) -> DataFrame:
    """Start and finish rows of a history."""
    both = F.array(
        F.struct(F.lit("start").alias("kind"), F.col("started").alias("at"), F.lit(None).cast("int").alias("status")),
        F.struct(F.lit("finish").alias("kind"), (F.col("started") + F.col("duration")).alias("at"), F.col("status").alias("status")),
    )
    return inv.select("id", F.explode(both).alias("x")).select("id", "x.*").filter("kind = 'start' or status is not null")


class Streamed:
    """Stands for a session whose reads of one driver table are streams, so that a batch view over it is a streaming one."""

    def __init__(self, spark: SparkSession, sf_dir: str, name: str):
        self.name, self.spark, self.read = name, spark, self
        self.schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema

    def parquet(self, path: str) -> DataFrame:
        return source(self.spark, path.replace(f"/{self.name}.parquet", f"/[{self.name[0]}]{self.name[1:]}.parquet"), self.schema)


def event_counts(lines: DataFrame) -> DataFrame:
    """(id, events) of response lines: how many are JSON objects."""
    from telemill.operators.stream import events

    return events(lines).groupBy("id").agg(F.count_if(F.col("event").isNotNull()).alias("events"))


def collected(stream: DataFrame, mode: str, trigger: dict | None = None) -> DataFrame:
    """Runs a stream over what is there now and gives what it wrote.

    Rows and state go to the shared folder, never to the driver: appended rows as one
    table, and of complete results the last one.
    """
    home = folder(stream.sparkSession, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{home}/rows/batch={number}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{home}/checkpoint").trigger(**(trigger or {"availableNow": True})).foreachBatch(write).start()
    if trigger is None:
        q.awaitTermination()
    else:  # a processing-time trigger polls without end
        q.processAllAvailable()
        q.stop()
    rows = stream.sparkSession.read.schema(StructType([*stream.schema.fields, StructField("batch", IntegerType())])).parquet(f"{home}/rows")
    if mode == "complete":
        rows = rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch")
    return rows.drop("batch")


def guarded(write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A side sink for foreachBatch whose failure is logged and never stops the stream."""

    def run(batch: DataFrame, number: int) -> None:
        try:
            write(batch, number)
        except Exception:
            logging.getLogger(__name__).exception("side sink failed in batch %d", number)

    return run
