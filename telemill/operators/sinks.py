"""Sinks: partitioned history and log tables, single-record downloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_history(inv: DataFrame, path: str) -> None:
    """Appends by day of start, so that time filters prune partitions and retention drops them."""
    day = F.to_date(F.timestamp_micros(F.round(F.col("started") * 1e6).cast("bigint")))
    inv.withColumn("started_date", day).write.mode("append").partitionBy("started_date").parquet(path)


def append_logs(lines: DataFrame, path: str) -> None:
    lines.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def write_samples(samples: DataFrame, path: str) -> None:
    """Appends scraped samples by job."""
    samples.write.mode("append").partitionBy("job").parquet(path)


def download(inv: DataFrame, identifier: str) -> DataFrame:
    """One record as JSON, nulls kept."""
    from telemill.operators.history import detail

    return detail(inv, identifier).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("document"))


def first_named(items: DataFrame, name: str | Column, column: str = "name") -> DataFrame:
    """An entry of that name; a column may be a scalar subquery."""
    return items.filter(F.col(column) == name).limit(1)


def up_rows(probes: DataFrame) -> DataFrame:
    """(target, up): 0 for a target whose version or state could not be read."""
    return probes.select("target", (F.col("version").isNotNull() & F.col("state").isNotNull()).cast("int").alias("up"))


def with_state(measures: DataFrame, loaded: DataFrame) -> DataFrame:
    """Request measures a model beside its loaded state; models that are not loaded have loaded = 0."""
    out = measures.join(loaded, "model", "left")
    return out.withColumn("loaded", F.coalesce("loaded", F.lit(0)))
