"""Folding response streams (id, seq, line[, at]) into one row a request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.functions.events import as_text, calls_tools, error_text, event_text, final_measurement, is_object, opened, parsed, shown_content, shown_thinking, truthy
from telemill.sources.tables import running

#: Numbers of lines that one task folds of a stream.
STRETCH = 16384


def events(lines: DataFrame) -> DataFrame:
    """Lines with `event` (variant, null if the line holds no JSON object) and `is_done_mark`."""
    mark = F.regexp_replace(F.col("line"), r"\A\s+|\s+\z", "").rlike(r"\Adata:\s*\[DONE\]\z")
    return lines.withColumns({"event": parsed(F.col("line")), "is_done_mark": mark})


def texts(lines: DataFrame) -> DataFrame:
    """(id, seq, text, content, thinking) of each event."""
    e = opened(events(lines).filter("event is not null"))
    x = F.col("x")
    return e.select("id", "seq", event_text(x).alias("text"), shown_content(x).alias("content"), shown_thinking(x).alias("thinking"))


def folded(lines: DataFrame) -> DataFrame:
    """(id, text, content, thinking, events, first_seq, first_at, complete, error, measurement): last measurement and last non-empty error win.

    Lines are dealt by id and stretch of seq before they are parsed, so that parsing is
    spread however long a stream is; stretches are folded where they are, and one row
    each goes on to the fold of the stream. first_at is the time of the first text,
    if lines have `at`.
    """
    x = F.col("x")
    at = F.col("at") if "at" in lines.columns else F.lit(None).cast("double")
    known = F.col("event").isNotNull()
    e = opened(events(lines.withColumns({"at": at, "_part": F.floor(F.col("seq") / STRETCH)}).repartition("id", "_part")))
    # the higher-order function keeps this projection out of whole-stage code, where it would be one method too long to be compiled
    seq = F.transform(F.array("seq"), lambda s: s)[0]
    e = e.select(
        "id",
        "_part",
        seq.alias("seq"),
        "at",
        "is_done_mark",
        known.alias("known"),
        F.when(known, event_text(x)).alias("text"),
        F.when(known, shown_content(x)).alias("content"),
        F.when(known, shown_thinking(x)).alias("thinking"),
        final_measurement(x).alias("m"),
        error_text(x).alias("err"),
        truthy(x["e"]["done"]).alias("done"),
    )
    said = (F.col("text") != "") | (F.col("content") != "") | (F.col("thinking") != "")
    joined = lambda c: F.array_join(F.transform("said", lambda r: r[c]), "").alias(c)
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"_{c}_seq")
    part = e.groupBy("id", "_part").agg(
        F.array_sort(F.collect_list(F.when(said, F.struct("seq", "text", "content", "thinking")))).alias("said"),
        F.count_if("known").alias("events"),
        F.min(F.when(F.col("text") != "", F.col("seq"))).alias("first_seq"),
        F.min_by("at", F.when(F.col("text") != "", F.col("seq"))).alias("first_at"),
        F.bool_or(F.col("is_done_mark") | F.col("done")).alias("complete"),
        F.max_by("err", F.when(F.col("err").isNotNull(), F.col("seq"))).alias("err"),
        F.max_by("m", F.when(F.col("m").isNotNull(), F.col("seq"))).alias("m"),
        last("err"),
        last("m"),
    )
    part = part.select("id", "_part", joined("text"), joined("content"), joined("thinking"), *[c for c in part.columns if c not in ("id", "_part", "said")])
    g = part.groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("_part", "text", "content", "thinking"))).alias("said"),
        F.sum("events").alias("events"),
        F.min("first_seq").alias("first_seq"),
        F.min_by("first_at", "first_seq").alias("first_at"),
        F.bool_or("complete").alias("complete"),
        F.max_by("err", "_err_seq").alias("error"),
        F.max_by("m", "_m_seq").alias("measurement"),
    )
    return g.select("id", joined("text"), joined("content"), joined("thinking"), *[c for c in g.columns if c not in ("id", "said")])


def with_body_measurement(fold: DataFrame, bodies: DataFrame) -> DataFrame:
    """What a whole (perhaps pretty-printed) body says, unless it was truncated: its measurement replaces the lines' one if it measures something, its error the lines' one."""
    known = bodies.withColumn("_v", parsed(F.col("response")))
    whole = opened(known.filter(~F.coalesce("truncated", F.lit(False)) & F.col("_v").isNotNull()), "_v").select("id", final_measurement(F.col("x")).alias("_m"), error_text(F.col("x")).alias("_err"))
    out = fold.join(whole, "id", "left")
    measured = F.when(F.col("_m").isNotNull() & ~F.col("_m.empty"), F.col("_m")).otherwise(F.col("measurement"))
    return out.withColumns({"measurement": measured, "error": F.coalesce("_err", "error")}).drop("_m", "_err")


def tool_events(lines: DataFrame) -> DataFrame:
    return opened(events(lines).filter(F.col("event").isNotNull())).filter(calls_tools(F.col("x"))).select("id", "seq", "line")


def captured(lines: DataFrame, limit: int) -> DataFrame:
    """(id, response, truncated): the first `limit` bytes of each stream, a cut character replaced."""
    from telemill.functions.text import clipped_bytes

    kept = running(lines.withColumn("_n", F.octet_length("line") + 1), "_n", ("id",), ("seq",), F.floor(F.col("seq") / STRETCH)).withColumn("_before", F.col("running") - F.col("_n"))
    g = kept.groupBy("id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_before") < limit, F.struct("seq", "line")))), lambda x: F.concat(x["line"], F.lit("\n"))), "").alias("body"),
        F.sum("_n").alias("total"),
    )
    return g.select("id", clipped_bytes(F.col("body"), limit).alias("response"), (F.col("total") > limit).alias("truncated"))


def request_blocks(requests: DataFrame) -> DataFrame:
    """(id, position, label, body): system, messages, prompt and input of request JSON; what is no object is one `raw` block."""
    v = F.try_parse_json("request")
    known = is_object(v)
    part = lambda path: F.try_variant_get(v, path, "variant")
    text = lambda path: as_text(part(path))
    messages = F.transform(F.coalesce(F.try_variant_get(v, "$.messages", "array<variant>"), F.array().cast("array<variant>")), lambda m: F.struct(F.coalesce(F.nullif(F.try_variant_get(m, "$.role", "string"), F.lit("")), F.lit("Message")).alias("label"), F.to_json(m).alias("body")))
    one = lambda cond, label, body: F.when(cond, F.array(F.struct(F.lit(label).alias("label"), body.alias("body")))).otherwise(F.array().cast("array<struct<label: string, body: string>>"))
    own = F.concat(one(truthy(part("$.system")), "System", text("$.system")), messages, one(text("$.prompt").isNotNull(), "Prompt / input", text("$.prompt")), one(text("$.input").isNotNull(), "Input", text("$.input")))
    blocks = F.when(known, own).otherwise(one(F.lit(True), "raw", F.col("request")))
    return requests.select("id", F.posexplode(blocks).alias("position", "b")).select("id", "position", "b.label", "b.body")
