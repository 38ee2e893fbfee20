"""Log queries over (ts, line, labels...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.operators.timeseries import matched


def selected(lines: DataFrame, contains: str | None = None, **labels: tuple[str, str]) -> DataFrame:
    """Label matchers, then an unanchored regular expression over the line."""
    out = matched(lines, **labels)
    return out.filter(F.col("line").rlike(contains)) if contains else out


def count_over(lines: DataFrame, start: str, end: str) -> DataFrame:
    """Number of lines in (start, end]; 0 if there are none."""
    t = lines.filter((F.col("ts") > F.lit(start).cast("timestamp")) & (F.col("ts") <= F.lit(end).cast("timestamp")))
    return t.agg(F.count(F.lit(1)).alias("value"))


def volume(lines: DataFrame, step_seconds: int, label: str) -> DataFrame:
    """(at, label, value): lines a step and label; a missing label is ''."""
    w = F.window("ts", f"{step_seconds} seconds")
    return lines.groupBy(w.alias("_w"), F.coalesce(F.col(label), F.lit("")).alias(label)).agg(F.count(F.lit(1)).alias("value")).select(F.col("_w.start").alias("at"), label, "value")


def newest(lines: DataFrame, limit: int) -> DataFrame:
    return lines.orderBy(F.desc("ts"), F.desc("line_id")).limit(limit)


def relabelled(lines: DataFrame, drop_container: str | None = None) -> DataFrame:
    """`/name` of a raw container label becomes `container`; lines of a container that the expression matches wholly go."""
    out = lines.withColumn("container", F.regexp_extract("raw_container", r"\A/(.*)\z", 1))
    return matched(out, container=("!~", drop_container)) if drop_container else out


def probe_labels(targets: DataFrame, prober: str) -> DataFrame:
    """The copies of a probe's address: target parameter, instance, then the prober's own address."""
    return targets.withColumn("param_target", F.col("address")).withColumn("instance", F.col("param_target")).withColumn("address", F.lit(prober))
