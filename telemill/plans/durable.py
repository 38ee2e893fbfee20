"""Queries over tables that are written, compacted and retained in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.plans.queries import ORACLES
from telemill.plans.registry import micros, query
from telemill.plans.sql import GAUGES, INV, LOGS
from telemill.sources import tables
from telemill.sources.scratch import folder
from telemill.streaming.durable import Folder, History, expire, finish_rows, start_rows

PARTS = 3


def written(spark, d) -> History:
    """A history in three batches of ten days' starts, each request's finish a batch later; every batch comes twice, and the first again after the first compaction."""
    inv = tables.invocations(spark, d)
    h = History(spark, folder(spark, "history"))
    part = F.pmod(F.floor(F.col("started") / 864000), F.lit(PARTS))
    ended = inv.filter("status is not null")
    # of two finishes the later one counts, in whichever batch it comes
    early = ended.withColumns({"finish_seq": F.col("finish_seq") - 1_000_000_000, "status": F.lit(102).cast("int"), "duration": F.lit(0.0)})

    def batch(k: int) -> DataFrame:
        ends = finish_rows(ended.filter((part + 1) % PARTS == k)).unionByName(finish_rows(early.filter((part + 2) % PARTS == k)))
        return start_rows(inv.filter(part == k)).unionByName(ends)

    for k in range(PARTS):
        h.commit(batch(k), k)
        h.commit(batch(k), k)
        if k == 1:
            h.compact()
            h.commit(batch(0), 0)
    return h


@query(ORACLES["inv_fold"])
def inv_durable(spark, d):
    """The history as read while its last batches wait for compaction."""
    return written(spark, d).rows().select("id", "started", "model", "status", "duration", "prompt_tokens", "state")


@query(ORACLES["inv_fold"])
def inv_durable_compacted(spark, d):
    h = written(spark, d)
    h.compact()
    return h.rows().select("id", "started", "model", "status", "duration", "prompt_tokens", "state")


@query(
    f"""WITH {INV} SELECT id, CASE WHEN status IS NULL THEN CASE WHEN started < 1705300000 THEN 'interrupted' ELSE 'running' END WHEN status >= 400 OR coalesce(error, '') <> '' THEN 'error' ELSE 'completed' END AS state,
      CASE WHEN status IS NULL AND started < 1705300000 THEN 'Proxy restarted before completion' ELSE CASE WHEN status IS NOT NULL THEN error END END AS error FROM inv"""
)
def inv_durable_recovered(spark, d):
    """After a restart, and a compaction of a batch that comes again."""
    h = written(spark, d)
    h.recover(1705300000.0)
    h.commit(start_rows(tables.invocations(spark, d)), 7)
    h.compact()
    return h.rows().select("id", "state", "error")


@query(f"WITH {INV} SELECT id, CASE WHEN status IS NULL THEN 'running' ELSE 'done' END AS state, started FROM inv WHERE status IS NULL OR started >= 1706500000 - 10 * 86400")
def ret_history(spark, d):
    """Retention as a delete: old days go, but for requests that still run; a second run within the hour does nothing."""
    h = written(spark, d)
    h.retain(1706500000.0, 10)
    h.retain(1706500100.0, 1)
    return h.rows().select("id", F.when(F.col("state") == "running", "running").otherwise("done").alias("state"), "started")


def _expired(spark, rows: DataFrame, schema: str, border: str) -> DataFrame:
    """Rows by day, without those older than the moment."""
    f = Folder(spark, folder(spark, "table"))
    f.replace_days("rows", rows.withColumn("day", F.to_date("ts")))
    expire(f, "rows", schema, border[:10], F.col("ts") >= F.lit(border).cast("timestamp"))
    return f.read("rows", f"{schema}, day date").drop("day")


@query(f"WITH {GAUGES} SELECT metric, instance, epoch_us(ts) AS ts, value FROM samples WHERE ts >= TIMESTAMP '2024-01-15 18:30:00'")
def ret_samples(spark, d):
    """Fifteen days of samples."""
    out = _expired(spark, tables.gauge_samples(spark, d), "metric string, instance string, ts timestamp, value double", "2024-01-15 18:30:00")
    return micros(out, "ts")


@query(f"WITH {LOGS} SELECT line_id, epoch_us(ts) AS ts, line FROM logs WHERE ts >= TIMESTAMP '2024-01-16 06:00:00'")
def ret_logs(spark, d):
    """336 hours of log lines."""
    rows = tables.log_lines(spark, d).select("ts", "line", "line_id")
    return micros(_expired(spark, rows, "ts timestamp, line string, line_id long", "2024-01-16 06:00:00"), "ts").select("line_id", "ts", "line")
