"""Queries over response streams and request bodies of every shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.operators import stream
from telemill.plans.registry import query
from telemill.sources import readers, tables
from telemill.streaming import twins


def shaped_lines(spark, d) -> DataFrame:
    """(id, seq, line, at): assistant texts as streams of four shapes, each after a blank line and one that is no JSON."""
    c = tables.table(spark, d, "conversations").filter("role = 'assistant'")
    p = F.regexp_extract_all("text", F.lit(r"\s*\S+|\s+$"), F.lit(0))
    n = F.size(p)
    lit = lambda *xs: F.array(*[F.lit(x) for x in xs])
    each = lambda f: F.transform(p, lambda x: f(x))
    done = F.array(F.format_string('{"done":true,"eval_count":%d,"prompt_eval_count":4,"eval_duration":%d}', n, n * 1000000))
    usage = F.array(F.format_string('data: {"choices":[],"usage":{"prompt_tokens":17,"completion_tokens":%d}}', n))
    chunk = lambda name: each(lambda x: F.concat(F.lit('data: {"choices":[{"delta":'), F.to_json(F.struct(x.alias(name))), F.lit("}]}")))
    plain = F.concat(each(lambda x: F.to_json(F.struct(x.alias("response")))), done)
    sse = F.concat(chunk("content"), usage, lit("data: [DONE]"))
    chat = F.concat(lit('{"message":{"thinking":"hmm"}}'), each(lambda x: F.concat(F.lit('{"message":'), F.to_json(F.struct(x.alias("content"))), F.lit("}"))), done)
    broken = F.concat(chunk("reasoning"), usage, F.array(F.concat(F.lit('{"error":"late '), F.col("turn").cast("string"), F.lit('"}'))), lit('{"error":""}'))
    shape = F.col("conv_id") % 4
    lines = F.concat(lit("", "oops"), F.when(shape == 0, plain).when(shape == 1, sse).when(shape == 2, chat).otherwise(broken))
    out = c.select(F.concat_ws("-", "conv_id", "turn").alias("id"), "conv_id", F.posexplode(lines).alias("seq", "line"))
    return out.select("id", F.col("seq").cast("bigint").alias("seq"), "line", (F.col("conv_id") + F.col("seq") * 0.5).alias("at"))


SHAPED = """c AS (SELECT conv_id || '-' || turn AS id, conv_id, turn, text, ((conv_id % 4) + 4) % 4 AS shape, CAST(len(regexp_extract_all(text, '\\s*\\S+|\\s+$')) AS BIGINT) AS n FROM conversations WHERE role = 'assistant'),
  s AS (SELECT *, CASE WHEN shape = 2 OR n > 0 THEN 2::BIGINT END AS first_seq FROM c)"""


@query(
    f"""WITH {SHAPED} SELECT id, CASE WHEN shape = 2 THEN 'hmm' || text ELSE text END AS text, CASE WHEN shape = 3 THEN '' ELSE text END AS content,
      CASE shape WHEN 2 THEN 'hmm' WHEN 3 THEN text ELSE '' END AS thinking, n + CASE shape WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 1 END AS events, first_seq, conv_id + first_seq * 0.5::DOUBLE AS first_at,
      shape <> 3 AS complete, CASE WHEN shape = 3 THEN 'late ' || turn END AS error FROM s"""
)
def ev_shapes(spark, d):
    """Texts, markers, the last error that is not empty, and the first token's time, over all shapes of streams."""
    return stream.folded(shaped_lines(spark, d)).drop("measurement")


@query(
    f"""WITH {SHAPED} SELECT id, CASE WHEN shape IN (0, 2) THEN 4 ELSE 17 END::BIGINT AS prompt_tokens, n AS generated_tokens, CASE WHEN shape IN (0, 2) THEN n * 1000000 END AS eval_ns,
      shape IN (0, 2) AS has_eval_ns, false AS has_load_ns FROM s"""
)
def ev_measurement(spark, d):
    """The last measurement of each stream: native counts and times, or usage."""
    m = stream.folded(shaped_lines(spark, d))
    return m.select("id", "measurement.prompt_tokens", "measurement.generated_tokens", "measurement.eval_ns", "measurement.has_eval_ns", "measurement.has_load_ns")


@query(
    """SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 4 = 3 THEN NULL WHEN event_id % 4 = 2 THEN 3 ELSE event_id % 50 END::BIGINT AS prompt_tokens,
      CASE WHEN event_id % 4 = 1 THEN 'bad ' || event_type WHEN event_id % 4 = 2 THEN 'early' END AS error FROM events"""
)
def ev_body(spark, d):
    """Pretty-printed bodies, whose lines say nothing: the whole is parsed unless it was truncated, and its error replaces an earlier one."""
    e = tables.table(spark, d, "events").withColumn("k", F.col("event_id") % 4)
    error = F.when(F.col("k") == 1, F.concat(F.lit(',\n  "error": "bad '), "event_type", F.lit('"'))).otherwise("")
    body = F.concat(F.lit('{\n  "prompt_eval_count": '), (F.col("event_id") % 50).cast("string"), error, F.lit("\n}\n"))
    bodies = e.select(F.col("event_id").cast("string").alias("id"), body.alias("response"), (F.col("k") >= 2).alias("truncated"), "k")
    early = F.when(F.col("k") == 2, F.array(F.lit('{"error":"early","prompt_eval_count":3}'))).otherwise(F.array().cast("array<string>"))
    lines = bodies.select("id", F.posexplode(F.concat(early, F.split("response", "\n"))).alias("seq", "line"))
    out = stream.with_body_measurement(stream.folded(lines), bodies)
    return out.select("id", "measurement.prompt_tokens", "error")


CAPTURED = """l AS (SELECT user_id, string_agg(event_type || ' ' || props || chr(10), '' ORDER BY event_id) AS body FROM events GROUP BY user_id)"""


@query(f"WITH {CAPTURED} SELECT CAST(user_id AS VARCHAR) AS id, left(body, 700) AS response, length(body) > 700 AS truncated FROM l")
def ev_capture(spark, d):
    """The first 700 bytes of each user's lines, as they stand."""
    e = tables.table(spark, d, "events")
    lines = e.select(F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("seq"), F.concat_ws(" ", "event_type", "props").alias("line"))
    return stream.captured(lines, 700)


@query(
    """WITH e AS (SELECT CAST(event_id AS VARCHAR) AS id, event_id % 4 AS k, event_type AS t FROM events)
    SELECT id, 0 AS position, CASE k WHEN 0 THEN 'System' WHEN 1 THEN 'Prompt / input' WHEN 2 THEN 'Input' ELSE 'raw' END AS label,
      CASE k WHEN 0 THEN 'be ' || t WHEN 1 THEN 'ask ' || t WHEN 2 THEN 'embed ' || t ELSE 'not json ' || t END AS body FROM e
    UNION ALL SELECT id, 1, 'user', '{"content":"' || t || '","role":"user"}' FROM e WHERE k = 0
    UNION ALL SELECT id, 2, 'Message', '{"content":"bare"}' FROM e WHERE k = 0"""
)
def ev_request_blocks(spark, d):
    """System text, messages, prompt and input of request bodies, and bodies that are no JSON."""
    e = tables.table(spark, d, "events")
    t, k = F.col("event_type"), F.col("event_id") % 4
    chat = F.concat(F.lit('{"system":"be '), t, F.lit('","messages":[{"role":"user","content":"'), t, F.lit('"},{"content":"bare"}]}'))
    body = F.when(k == 0, chat).when(k == 1, F.concat(F.lit('{"prompt":"ask '), t, F.lit('"}'))).when(k == 2, F.concat(F.lit('{"input":"embed '), t, F.lit('"}'))).otherwise(F.concat(F.lit("not json "), t))
    return stream.request_blocks(e.select(F.col("event_id").cast("string").alias("id"), body.alias("request")))


@query("SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN 'm' || user_id ELSE 'unknown' END AS model FROM events")
def req_model(spark, d):
    """The model that a request body names; bodies that are no object, and blank or absent names, are unknown."""
    e = tables.table(spark, d, "events")
    k = F.col("event_id") % 5
    body = F.when(k == 0, F.concat(F.lit('{"model":"m'), F.col("user_id").cast("string"), F.lit('","stream":false}'))).when(k == 1, '{"model":""}').when(k == 2, "[1]").when(k == 3, "{oops").otherwise("{}")
    return e.select(F.col("event_id").alias("id"), readers.model_of(readers.request_payload(body)).alias("model"))


@query("SELECT conv_id || '-' || turn AS id, CAST(len(regexp_extract_all(text, '\\s*\\S+|\\s+$')) AS BIGINT) + CASE ((conv_id % 4) + 4) % 4 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 1 END AS events FROM conversations WHERE role = 'assistant'")
def str_lines(spark, d):
    """The streaming twin of line parsing: events counted a stream as lines arrive."""
    lines = shaped_lines(twins.Streamed(spark, d, "conversations"), d)
    return twins.collected(twins.event_counts(lines), "complete")


#: Lines as a table that both engines build alike; what they say is read by each engine's own JSON functions.
LINES = """l AS (SELECT CAST(user_id AS VARCHAR) AS id, event_id AS seq, CASE event_id % 5 WHEN 0 THEN '{"response": "' || event_type || ' "}' WHEN 1 THEN 'data: {"choices":[{"delta":{"content":"' || event_type || '"}}]}'
    WHEN 2 THEN props WHEN 3 THEN '  data: {"message":{"content":"m' || event_type || '"},"prompt_eval_count":' || event_id % 50 || '}' ELSE 'data: oops ' || event_type END AS line FROM events),
  j AS (SELECT id, seq, regexp_replace(trim(line), '^data:\\s*', '') AS body FROM l),
  p AS (SELECT id, seq, CASE WHEN json_valid(body) THEN body END AS body FROM j),
  x AS (SELECT id, seq, body IS NOT NULL AS known, coalesce(json_extract_string(body, '$.response'), json_extract_string(body, '$.choices[0].delta.content'), json_extract_string(body, '$.message.content'), '') AS text,
    CAST(json_extract_string(body, '$.prompt_eval_count') AS BIGINT) AS tokens FROM p)"""


@query(
    f"""WITH {LINES} SELECT id, coalesce(string_agg(text, '' ORDER BY seq), '') AS text, CAST(count(*) FILTER (known) AS BIGINT) AS events, min(seq) FILTER (text <> '') AS first_seq,
      arg_max(tokens, seq) FILTER (tokens IS NOT NULL) AS prompt_tokens FROM x GROUP BY id"""
)
def ev_parsed(spark, d):
    """Streams of every shape, whose expected texts come from parsing the same lines."""
    e = tables.table(spark, d, "events").withColumn("k", F.col("event_id") % 5)
    t, props, k = F.col("event_type"), F.col("props"), F.col("k")
    line = (
        F.when(k == 0, F.concat(F.lit('{"response": "'), t, F.lit(' "}')))
        .when(k == 1, F.concat(F.lit('data: {"choices":[{"delta":{"content":"'), t, F.lit('"}}]}')))
        .when(k == 2, props)
        .when(k == 3, F.concat(F.lit('  data: {"message":{"content":"m'), t, F.lit('"},"prompt_eval_count":'), (F.col("event_id") % 50).cast("string"), F.lit("}")))
        .otherwise(F.concat(F.lit("data: oops "), t))
    )
    out = stream.folded(e.select(F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("seq"), line.alias("line")))
    return out.select("id", "text", "events", "first_seq", F.col("measurement.prompt_tokens").alias("prompt_tokens"))
