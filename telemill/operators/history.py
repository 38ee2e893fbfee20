"""Invocation history: search, paging, statistics, retention and lifecycle."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.functions.text import contains_literal, or_blank
from telemill.schemas import MARKED, TRACKED

PAGE = 50
LISTED = ("id", "started", "model", "endpoint", "source", "purpose", "state", "status", "duration", "ttft", "prompt_tokens", "generated_tokens", "truncated")
#: Messages of interrupted and unfinished requests. Fixed values.
RESTARTED = "Proxy restarted before completion"
UNFINISHED = "Upstream stream ended without a completion marker"


@dataclass(frozen=True)
class Search:
    """Validated search parameters; blank text means no filter."""

    q: str = ""
    model: str = ""
    source: str = ""
    state: str = ""
    since: float = 0.0
    offset: int = 0

    @classmethod
    def of(cls, params: dict[str, list[str]]) -> Search:
        """From query-string lists (first values count); ValueError for what is not a number or beyond 64 bits."""
        first = {k: v[0] for k, v in params.items() if v}
        offset = max(0, int(first.get("offset", "0")))
        if offset >= 1 << 63:
            raise ValueError("offset is out of range")
        return cls(first.get("q", ""), first.get("model", ""), first.get("source", ""), first.get("state", ""), float(first.get("since", "0")), offset)


def preset_since(now: float, hours: int | None) -> float:
    """Lower bound of a time preset; None is all time."""
    return 0.0 if hours is None else now - hours * 3600


def matching(inv: DataFrame, s: Search) -> DataFrame:
    """Only active clauses enter the plan; equality and time reach the Parquet scan."""
    out = inv
    for field in ("model", "source", "state"):
        if getattr(s, field):
            out = out.filter(F.col(field) == getattr(s, field))
    if s.q:
        blank = F.lit("")
        out = out.filter(contains_literal(F.concat(F.coalesce("request", blank), F.coalesce("response", blank), "source", "purpose"), s.q))
    return out.filter(F.lit(False) if math.isnan(s.since) else F.col("started") >= s.since)


def listing(inv: DataFrame) -> DataFrame:
    """The list's columns with a 200-character preview; bodies and errors stay behind."""
    return inv.select(*LISTED, F.substring("request", 1, 200).alias("preview"))


def page(inv: DataFrame, s: Search) -> DataFrame:
    """One page, newest first, ties by id: a bounded top-k."""
    return listing(matching(inv, s)).orderBy(F.desc("started"), "id").offset(s.offset).limit(PAGE)


def statistics(inv: DataFrame, s: Search) -> DataFrame:
    """Aggregates over all matching rows, not only the page."""
    return matching(inv, s).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("state") == "running").alias("running"),
        F.count_if(F.col("state").isin("error", "interrupted")).alias("errors"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("generated_tokens").alias("generated_tokens"),
        F.avg("duration").alias("average_duration"),
    )


def values(inv: DataFrame, column: str) -> DataFrame:
    """Distinct values in order, nulls first, regardless of any search."""
    return inv.select(column).distinct().orderBy(F.asc_nulls_first(column))


def detail(inv: DataFrame, identifier: str) -> DataFrame:
    return inv.filter(F.col("id") == identifier).limit(1)


def metadata(inv: DataFrame) -> DataFrame:
    return inv.drop("request", "response")


def measurement(inv: DataFrame) -> DataFrame:
    """A record as reports hold it: all but the response's text."""
    return inv.drop("response")


def pager(inv: DataFrame, s: Search) -> DataFrame:
    """(total, has_previous, has_next, label) of the page."""
    total = F.col("total")
    last = F.least(total, F.lit(s.offset + PAGE))
    first = F.when(total > 0, s.offset + 1).otherwise(0)
    return matching(inv, s).agg(F.count(F.lit(1)).alias("total")).select(
        total,
        F.lit(s.offset > 0).alias("has_previous"),
        (s.offset + PAGE < total).alias("has_next"),
        F.concat(first.cast("string"), F.lit("–"), last.cast("string"), F.lit(" of "), total.cast("string")).alias("label"),
    )


def retained(inv: DataFrame, now: float, days: float) -> DataFrame:
    """Without finished rows that are older than `days`; days <= 0 keeps all. Rows of unknown state stay."""
    if days <= 0:
        return inv
    gone = (F.col("started") < now - days * 86400) & (F.col("state") != "running")
    return inv.filter(~F.coalesce(gone, F.lit(False)))


def recovered(inv: DataFrame, boot: float) -> DataFrame:
    """Rows still running that began before the restart become interrupted."""
    lost = (F.col("state") == "running") & (F.col("started") < boot)
    return inv.withColumns({"error": F.when(lost, RESTARTED).otherwise(F.col("error")), "state": F.when(lost, "interrupted").otherwise(F.col("state"))})


def terminal_state(status: Column, error: Column) -> Column:
    failed = F.coalesce(status >= 400, F.lit(False)) | (F.coalesce(error, F.lit("")) != "")
    return F.when(failed, "error").otherwise("completed")


def tracked(method: Column, path: Column) -> Column:
    return (method == "POST") & F.split_part(path, F.lit("?"), F.lit(1)).isin(*TRACKED)


def caller(header: Column, agent: Column, ip: Column) -> Column:
    return F.coalesce(or_blank(header), F.concat(F.coalesce(agent, F.lit("Unknown client")), F.lit(" ("), ip, F.lit(")")))


def completion_error(status: Column, stream: Column, endpoint: Column, complete: Column, error: Column) -> Column:
    """The message of a stream that ended without its marker; an earlier message stays. Streams are the default but for /v1/ paths."""
    streams = F.coalesce(stream, ~endpoint.startswith("/v1/"))
    cut = (status < 400) & streams & endpoint.isin(*MARKED) & ~F.coalesce(complete, F.lit(False))
    return F.when(cut, F.coalesce(or_blank(error), F.lit(UNFINISHED))).otherwise(error)


def folded(starts: DataFrame, finishes: DataFrame) -> DataFrame:
    """Start rows completed by finish rows of the same id (the last finish wins): history on immutable files, in one aggregation by id."""
    outcome = ("status", "duration", "ttft", "prompt_tokens", "generated_tokens", "response", "truncated", "error")
    first = ("started", "model", "endpoint", "source", "purpose", "request")
    s = starts.select("id", F.struct(*first).alias("s"), F.lit(None).cast("bigint").alias("seq"), F.lit(None).cast(_struct(finishes, outcome)).alias("f"))
    f = finishes.select("id", F.lit(None).cast(_struct(starts, first)).alias("s"), F.col("finish_seq").alias("seq"), F.struct(*outcome).alias("f"))
    g = s.unionByName(f).groupBy("id").agg(F.max("s").alias("s"), F.max_by("f", "seq").alias("f"))
    g = g.filter("s is not null").select("id", "s.*", "f.*", F.col("f").isNotNull().alias("_done"))
    return g.withColumn("state", F.when(F.col("_done"), terminal_state(F.col("status"), F.col("error"))).otherwise("running")).drop("_done")


def _struct(df: DataFrame, names) -> str:
    return "struct<" + ", ".join(f"{n}: {df.schema[n].dataType.simpleString()}" for n in names) + ">"


def api_document(inv: DataFrame, s: Search, retention_days: int = 30) -> DataFrame:
    """One JSON document: rows, stats, models, sources, retention_days; a page and two lists, so bounded by them."""
    rows = page(inv, s).agg(F.to_json(F.array_sort(F.collect_list(F.struct((-F.col("started")).alias("_o"), *[F.col(c) for c in (*LISTED, "preview")]))), {"ignoreNullFields": "false"}).alias("rows"))
    listed = lambda c: inv.agg(F.to_json(F.array_sort(F.collect_set(c))).alias(f"{c}s"))
    stats = statistics(inv, s).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("stats"))
    one = rows.crossJoin(stats).crossJoin(listed("model")).crossJoin(listed("source"))  # four one-row frames
    return one.select(F.format_string('{"rows":%s,"stats":%s,"models":%s,"sources":%s,"retention_days":%d}', F.regexp_replace("rows", r'"_o":[^,]*,', ""), "stats", "models", "sources", F.lit(retention_days)).alias("document"))
