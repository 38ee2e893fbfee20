"""Readers of the raw inputs: stream lines, host memory, card rows, range results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from telemill.schemas import INVOCATION, STREAM_LINE


def invocation_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INVOCATION).parquet(path)


def ndjson_lines(spark: SparkSession, path: str) -> DataFrame:
    """(id, seq, line) from text files, a stream a file; id is the file's path.

    Files are read line by line. seq is the place of the line's block in the file,
    then the line's place in the block, so it grows with the file but has gaps.
    """
    block, row = F.col("_metadata.file_block_start"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("id"), (F.shiftleft(F.floor(block / (1 << 20)).cast("bigint"), 33) + row).alias("seq"), F.col("value").alias("line"))
    return lines.to(STREAM_LINE)


def meminfo(lines: DataFrame) -> DataFrame:
    """(name, gib) from `Name:   N kB` lines (value)."""
    name, kb = F.regexp_extract("value", r"\A(\w+(?:\(\w+\))?):\s+(\d+) kB", 1), F.regexp_extract("value", r"\A(\w+(?:\(\w+\))?):\s+(\d+) kB", 2)
    return lines.select(name.alias("name"), (F.nullif(kb, F.lit("")).cast("double") / 1024 / 1024).alias("gib")).filter("name <> ''")


def card_rows(lines: DataFrame, fields: tuple[str, ...] = ("name", "driver_version", "memory_total", "power_limit")) -> DataFrame:
    """Columns of comma-separated device rows (value)."""
    schema = ", ".join(f"{f} string" for f in fields)
    return lines.select(F.from_csv("value", schema, {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}).alias("r")).select("r.*")


def request_payload(c):
    """A request body as a variant object; {} for what is none."""
    v = F.try_parse_json(c)
    return F.when(F.coalesce(F.schema_of_variant(v), F.lit("")).startswith("OBJECT"), v).otherwise(F.parse_json(F.lit("{}")))


def model_of(payload):
    return F.coalesce(F.nullif(F.try_variant_get(payload, "$.model", "string"), F.lit("")), F.lit("unknown"))


def quality_cases(spark: SparkSession, path: str) -> DataFrame:
    """Scored cases (case_id, category, prompt, expected, scorer) from JSON lines; expected is text or JSON text."""
    return spark.read.schema("case_id string, category string, prompt string, expected string, scorer string").json(path)


def probe_samples(probes: DataFrame) -> DataFrame:
    """(target, value) of HTTP probes (target, status: null if nothing answered): 1 for a 2xx answer."""
    return probes.select("target", F.coalesce((F.col("status") >= 200) & (F.col("status") < 300), F.lit(False)).cast("double").alias("value"))


def samples(spark: SparkSession, path: str, job: str | None = None) -> DataFrame:
    """Metric samples (metric, labels, ts, value, job) that were written by job; of one job only its partition is read."""
    from telemill.schemas import SAMPLE

    s = spark.read.schema(StructType([*SAMPLE.fields, StructField("job", StringType())])).parquet(path)
    return s if job is None else s.filter(F.col("job") == job)
