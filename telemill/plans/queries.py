"""Named queries over the driver tables, each with its SQL where SQL can say it.

Doubles that depend on the order of addition are rounded in both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.functions import measures, moments, text
from telemill.operators import alerts, history, logs, metrics, sinks, stats, stream, timeseries
from telemill.operators.history import Search
from telemill.plans.dashboards import PANELS, evaluate
from telemill.plans.registry import ORACLES, QUERIES, micros, query, r6
from telemill.plans.sql import ANSWERS, FIN, GAUGES, INV, LOGS, RUNS, SAMPLES
from telemill.sources import tables
from telemill.streaming import twins

__all__ = ["ORACLES", "QUERIES"]

# --- invocation history -------------------------------------------------------

LISTED = "id, started, model, endpoint, source, purpose, state, status, duration, ttft, prompt_tokens, generated_tokens, truncated, substr(request, 1, 200) AS preview"
FOUND = "instr(lower(coalesce(request, '') || coalesce(response, '') || source || purpose), '{}') > 0"  # the driver's rows of these columns are ASCII


@query(f"WITH {INV} SELECT * EXCLUDE (finish_seq) FROM inv")
def inv_scan(spark, d):
    return tables.invocations(spark, d).drop("finish_seq")


@query(f"WITH {INV} SELECT {LISTED} FROM inv ORDER BY inv.started DESC, id LIMIT 50")
def inv_page(spark, d):
    return history.page(tables.invocations(spark, d), Search())


@query(f"WITH {INV} SELECT {LISTED} FROM inv WHERE model = 'm3' AND state = 'completed' ORDER BY inv.started DESC, id LIMIT 50 OFFSET 50")
def inv_page2(spark, d):
    return history.page(tables.invocations(spark, d), Search(model="m3", state="completed", offset=50))


@query(f"WITH {INV} SELECT {LISTED} FROM inv WHERE source = 'c2' AND {FOUND.format('c2click')} AND inv.started >= 1704500000 ORDER BY inv.started DESC, id LIMIT 50")
def inv_search_ascii(spark, d):
    return history.page(tables.invocations(spark, d), Search(q="C2CLICK", source="c2", since=1704500000.0))


STATS = """count(*) AS requests, count(*) FILTER (state = 'running') AS running, count(*) FILTER (state IN ('error', 'interrupted')) AS errors,
  CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(generated_tokens) AS BIGINT) AS generated_tokens, round(avg(duration), 6) AS average_duration"""


@query(f"WITH {INV} SELECT {STATS} FROM inv WHERE {FOUND.format('error')} AND source = 'c1'")
def inv_stats(spark, d):
    return r6(history.statistics(tables.invocations(spark, d), Search(q="ERROR", source="c1")), "average_duration")


@query(f"WITH {INV} SELECT {STATS} FROM inv WHERE {FOUND.format(chr(39) * 2 + ' or 1=1 --')}")
def inv_stats_empty(spark, d):
    return r6(history.statistics(tables.invocations(spark, d), Search(q="' OR 1=1 --")), "average_duration")


@query(f"WITH {INV} SELECT DISTINCT model FROM inv ORDER BY model NULLS FIRST")
def inv_models(spark, d):
    return history.values(tables.invocations(spark, d), "model")


@query(f"WITH {INV} SELECT DISTINCT source FROM inv ORDER BY source NULLS FIRST")
def inv_sources(spark, d):
    return history.values(tables.invocations(spark, d), "source")


@query(f"WITH {INV} SELECT * EXCLUDE (finish_seq) FROM inv WHERE id = '42'")
def inv_detail(spark, d):
    return history.detail(tables.invocations(spark, d).drop("finish_seq"), "42")


@query(f"WITH {INV} SELECT * EXCLUDE (finish_seq, request, response) FROM inv")
def inv_metadata(spark, d):
    return history.metadata(tables.invocations(spark, d).drop("finish_seq"))


@query(
    f"""WITH {INV}, t AS (SELECT count(*) AS total FROM inv WHERE state = 'error')
    SELECT total, true AS has_previous, 100 < total AS has_next, CASE WHEN total > 0 THEN 51 ELSE 0 END || '–' || least(total, 100) || ' of ' || total AS label FROM t"""
)
def inv_pager(spark, d):
    return history.pager(tables.invocations(spark, d), Search(state="error", offset=50))


@query(f"WITH {INV} SELECT id, state, started FROM inv WHERE NOT coalesce(started < 1706500000 - 10 * 86400 AND state <> 'running', false)")
def inv_retention(spark, d):
    return history.retained(tables.invocations(spark, d), 1706500000.0, 10).select("id", "state", "started")


@query(
    f"""WITH {INV} SELECT id, CASE WHEN state = 'running' AND started < 1705300000 THEN 'interrupted' ELSE state END AS state,
    CASE WHEN state = 'running' AND started < 1705300000 THEN 'Proxy restarted before completion' ELSE error END AS error FROM inv"""
)
def inv_recover(spark, d):
    return history.recovered(tables.invocations(spark, d), 1705300000.0).select("id", "state", "error")


@query(
    f"""WITH {INV}, f AS (SELECT * FROM inv WHERE status IS NOT NULL)
    SELECT inv.id, inv.started, inv.model, f.status, f.duration, f.prompt_tokens,
      CASE WHEN f.id IS NULL THEN 'running' WHEN f.status >= 400 OR coalesce(f.error, '') <> '' THEN 'error' ELSE 'completed' END AS state
    FROM inv LEFT JOIN f ON inv.id = f.id"""
)
def inv_fold(spark, d):
    inv = tables.invocations(spark, d)
    out = history.folded(inv, inv.filter("status is not null"))
    return out.select("id", "started", "model", "status", "duration", "prompt_tokens", "state")


@query(f"WITH {INV} SELECT id, CASE WHEN coalesce(status >= 400, false) OR coalesce(error, '') <> '' THEN 'error' ELSE 'completed' END AS state FROM inv")
def inv_terminal_state(spark, d):
    return tables.invocations(spark, d).select("id", history.terminal_state(F.col("status"), F.col("error")).alias("state"))


@query(
    f"""WITH {INV} SELECT id, CASE WHEN status < 400 AND NOT starts_with(endpoint, '/v1/') AND endpoint IN ('/api/chat', '/api/generate') AND NOT truncated
      THEN coalesce(nullif(error, ''), 'Upstream stream ended without a completion marker') ELSE error END AS error FROM inv"""
)
def inv_completion_marker(spark, d):
    none = F.lit(None).cast("boolean")
    return tables.invocations(spark, d).select("id", history.completion_error(F.col("status"), none, F.col("endpoint"), F.col("truncated"), F.col("error")).alias("error"))


@query(f"WITH {INV} SELECT id, coalesce(nullif(purpose, ''), coalesce(model, 'Unknown client') || ' (' || source || ')') AS caller FROM inv")
def inv_caller(spark, d):
    return tables.invocations(spark, d).select("id", history.caller(F.col("purpose"), F.col("model"), F.col("source")).alias("caller"))


@query("SELECT event_id, event_type IN ('click', 'view') AND user_id % 2 = 0 AS tracked FROM events")
def inv_tracked(spark, d):
    e = tables.table(spark, d, "events")
    path = F.when(F.col("event_type").isin("click", "view"), "/api/chat?x=1").otherwise("/api/tags")
    method = F.when(F.col("user_id") % 2 == 0, "POST").otherwise("GET")
    return e.select("event_id", history.tracked(method, path).alias("tracked"))



# --- request metrics ----------------------------------------------------------


def finished(spark, d) -> DataFrame:
    i, e = F.col("finish_seq"), F.col("endpoint")
    local = e.isin("/api/chat", "/api/generate")
    return tables.invocations(spark, d).filter("status is not null").withColumns(
        {
            "prompt_ns": F.coalesce("prompt_tokens", F.lit(0)) * 1_000_000,
            "has_prompt_ns": local,
            "eval_ns": (i % 50) * 100_000_000,
            "has_eval_ns": local,
            "load_ns": (i % 7) * 10_000_000,
            "has_load_ns": e == "/api/chat",
        }
    )


@query(f"WITH {FIN} SELECT model, endpoint, CAST(status AS VARCHAR) AS status, count(*) AS requests FROM fin GROUP BY ALL")
def met_requests(spark, d):
    return metrics.request_counts(finished(spark, d))


@query(
    f"""WITH {FIN} SELECT model, CAST(sum(coalesce(prompt_tokens, 0)) AS BIGINT) AS prompt_tokens, CAST(sum(coalesce(generated_tokens, 0)) AS BIGINT) AS generated_tokens,
    round(sum(prompt_ns / 1e9) FILTER (has_prompt_ns), 6) AS prompt_seconds, round(sum(eval_ns / 1e9) FILTER (has_eval_ns), 6) AS eval_seconds,
    round(sum(load_ns / 1e9) FILTER (has_load_ns), 6) AS load_seconds FROM fin GROUP BY model"""
)
def met_tokens(spark, d):
    return r6(metrics.token_totals(finished(spark, d)), "prompt_seconds", "eval_seconds", "load_seconds")


@query(
    f"""WITH {FIN} SELECT model, round(arg_max(coalesce(generated_tokens, 0) / (eval_ns / 1e9), finish_seq) FILTER (has_eval_ns AND eval_ns <> 0), 6) AS last_decode,
    round(arg_max(coalesce(prompt_tokens, 0) / (prompt_ns / 1e9), finish_seq) FILTER (has_prompt_ns AND prompt_ns <> 0), 6) AS last_prompt FROM fin GROUP BY model"""
)
def met_last_rate(spark, d):
    return r6(metrics.last_rates(finished(spark, d)), "last_decode", "last_prompt")


def _hist_sql(value: str) -> str:
    bounds = "('0.1', 0.1), ('0.25', 0.25), ('0.5', 0.5), ('1', 1), ('2.5', 2.5), ('5', 5), ('10', 10), ('30', 30), ('60', 60), ('120', 120), ('300', 300), ('+Inf', 'infinity'::DOUBLE)"
    return f"""WITH {FIN}, v AS (SELECT model, endpoint, {value} AS v FROM fin), b(le, bound) AS (VALUES {bounds})
      SELECT model, endpoint, le, count(*) FILTER (v <= bound::DOUBLE) AS count, count(v) AS total, round(sum(v), 6) AS sum FROM v, b WHERE v IS NOT NULL GROUP BY model, endpoint, le"""


@query(_hist_sql("duration"))
def met_hist_duration(spark, d):
    return r6(metrics.histogram(finished(spark, d), "duration"), "sum")


@query(_hist_sql("ttft"))
def met_hist_ttft(spark, d):
    return r6(metrics.histogram(finished(spark, d), "ttft"), "sum")


@query(_hist_sql("CASE WHEN ttft IS NOT NULL AND has_load_ns AND has_prompt_ns THEN greatest(ttft - load_ns / 1e9 - prompt_ns / 1e9, 0) END"))
def met_hist_queue(spark, d):
    return r6(metrics.histogram(metrics.with_queue(finished(spark, d)), "queue"), "sum")


@query(
    f"""WITH {INV}, e AS (SELECT started AS t, 1 AS d FROM inv UNION ALL SELECT started + duration, -1 FROM inv WHERE duration IS NOT NULL),
    g AS (SELECT t, sum(d) AS d FROM e GROUP BY t) SELECT t AS "at", CAST(sum(d) OVER (ORDER BY t) AS BIGINT) AS active FROM g"""
)
def met_active(spark, d):
    return metrics.active_over_time(tables.invocations(spark, d))


@query(f"WITH {INV} SELECT count(*) FILTER (state = 'running') AS active FROM inv")
def met_active_now(spark, d):
    return metrics.active_now(tables.invocations(spark, d))


@query(
    f"""WITH {FIN}, m AS (SELECT model, row_number() OVER (ORDER BY min(finish_seq)) AS r FROM fin GROUP BY model),
    c AS (SELECT CASE WHEN r <= 32 THEN model ELSE 'other' END AS model, endpoint, CAST(status AS VARCHAR) AS status FROM fin JOIN m USING (model))
    SELECT model, endpoint, status, count(*) AS requests FROM c GROUP BY ALL"""
)
def met_model_cap(spark, d):
    return metrics.request_counts(metrics.capped_models(finished(spark, d)))


@query(
    f"""WITH {FIN}, c AS (SELECT model, endpoint, CAST(status AS VARCHAR) AS status, count(*) AS n FROM fin GROUP BY ALL)
    SELECT 'ollama_requests_total' AS name, 'ollama_requests_total{{model="' || model || '",endpoint="' || endpoint || '",status="' || status || '"}} ' || n AS line FROM c"""
)
def met_exposition(spark, d):
    return metrics.exposition(metrics.request_series(finished(spark, d)))



@query(
    """SELECT p_name AS model, 1 AS loaded, p_size AS size_bytes, p_size // 2 AS vram_bytes, p_size + 1 AS context_length, CAST(p_size // 2 AS DOUBLE) / nullif(p_size, 0) * 100 AS offload_percent,
    p_size <> 0 AND p_size // 2 = p_size AS "full" FROM part"""
)
def met_model_state(spark, d):
    p = tables.table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.expr("cast(p_size div 2 as int)").alias("size_vram"), (F.col("p_size") + 1).alias("context_length"))
    return metrics.model_state(p)


# --- response streams ---------------------------------------------------------

ASSIST = "a AS (SELECT conv_id || '-' || turn AS id, text FROM conversations WHERE role = 'assistant')"


@query(f"WITH {ASSIST} SELECT id, len(regexp_extract_all(text, '\\s*\\S+|\\s+$')) + 1 AS events FROM a")
def ev_parse(spark, d):
    e = stream.events(tables.stream_lines(spark, d))
    return e.groupBy("id").agg(F.count_if(F.col("event").isNotNull()).alias("events"))


@query(f"WITH {ASSIST} SELECT id, CAST(sum(length(p)) AS BIGINT) AS chars FROM (SELECT id, unnest(regexp_extract_all(text, '\\s*\\S+|\\s+$')) AS p FROM a) GROUP BY id")
def ev_text(spark, d):
    return stream.texts(tables.stream_lines(spark, d)).groupBy("id").agg(F.sum(F.length("text")).alias("chars")).filter("chars > 0")


@query(f"WITH {ASSIST} SELECT id, 4::BIGINT AS prompt_tokens, CAST(len(regexp_extract_all(text, '\\s*\\S+|\\s+$')) AS BIGINT) AS generated_tokens, true AS complete FROM a")
def ev_final(spark, d):
    f = stream.folded(tables.stream_lines(spark, d))
    return f.select("id", "measurement.prompt_tokens", "measurement.generated_tokens", "complete")


@query(f"WITH {ASSIST} SELECT id, text, text AS content, '' AS thinking FROM a")
def ev_fold(spark, d):
    return stream.folded(tables.stream_lines(spark, d)).select("id", "text", "content", "thinking")


def tool_lines(spark, d) -> DataFrame:
    c = tables.table(spark, d, "conversations")
    calls = F.when(F.col("role") == "assistant", '{"message":{"tool_calls":[{"name":"f"}]}}').when(F.col("role") == "user", 'data: {"choices":[{"delta":{}},{"message":{"tool_calls":[1]}}]}').otherwise('{"message":{"tool_calls":[]}}')
    return c.select(F.col("conv_id").cast("string").alias("id"), F.col("turn").cast("bigint").alias("seq"), calls.alias("line"))


@query("SELECT CAST(conv_id AS VARCHAR) AS id, CAST(turn AS BIGINT) AS seq FROM conversations WHERE role IN ('assistant', 'user')")
def ev_tools(spark, d):
    return stream.tool_events(tool_lines(spark, d)).select("id", "seq")


# --- benchmark statistics -----------------------------------------------------

DIST = """count({v}) AS count, min({v}) AS min, round(avg({v}), 6) AS mean, round(median({v}), 6) AS median, round(quantile_cont({v}, 0.95), 6) AS p95, max({v}) AS max,
  round(stddev_samp({v}), 6) AS standard_deviation, round(stddev_samp({v}) / nullif(avg({v}), 0) * 100, 6) AS coefficient_of_variation_percent"""
DIST_ROUND = ("mean", "median", "p95", "standard_deviation", "coefficient_of_variation_percent")


@query(f"WITH {RUNS} SELECT {DIST.format(v='wall_seconds')} FROM runs")
def st_summary(spark, d):
    return r6(stats.summary(tables.runs(spark, d), "wall_seconds"), *DIST_ROUND)


@query(f"WITH {RUNS} SELECT phase, {DIST.format(v='decode_seconds')} FROM runs GROUP BY phase")
def st_by_group(spark, d):
    return r6(stats.summary(tables.runs(spark, d), "decode_seconds", "phase"), *DIST_ROUND)


@query(f"WITH {RUNS} SELECT phase, round(quantile_cont(ttft, 0.5), 6) AS p50, round(quantile_cont(ttft, 0.95), 6) AS p95 FROM runs GROUP BY phase")
def st_percentile(spark, d):
    return r6(stats.percentiles(tables.runs(spark, d), "ttft", {"p50": 0.5, "p95": 0.95}, "phase"), "p50", "p95")


RATES = """phase, seq, CASE WHEN decode_seconds > 0 THEN round(output_tokens / decode_seconds, 6) END AS decode_tokens_per_second,
  CASE WHEN wall_seconds - ttft > 0 THEN round(greatest(output_tokens - 1, 0) / (wall_seconds - ttft), 6) END AS wall_tokens_per_second_after_first_token,
  CASE WHEN wall_seconds > 0 THEN round(output_tokens / wall_seconds, 6) END AS end_to_end_tokens_per_second"""


def rated(spark, d) -> DataFrame:
    c = F.col
    rates = measures.generation_rates(c("prompt_tokens"), c("ttft"), c("output_tokens"), c("decode_seconds"), c("wall_seconds"), c("ttft"))
    return tables.runs(spark, d).withColumns(rates)


@query(f"WITH {RUNS} SELECT {RATES} FROM runs")
def st_rates(spark, d):
    names = ("decode_tokens_per_second", "wall_tokens_per_second_after_first_token", "end_to_end_tokens_per_second")
    return r6(rated(spark, d).select("phase", "seq", *names), *names)


@query(
    f"""WITH {RUNS}, s AS (SELECT phase, seq, output_tokens / decode_seconds AS v FROM runs WHERE decode_seconds > 0),
    h AS (SELECT phase, v, row_number() OVER (PARTITION BY phase ORDER BY seq) <= greatest(count(*) OVER (PARTITION BY phase) // 2, 1) AS head FROM s),
    g AS (SELECT phase, avg(v) FILTER (head) AS a, avg(v) FILTER (NOT head) AS b FROM h GROUP BY phase)
    SELECT p.phase, round((coalesce(b, a) - a) / nullif(a, 0) * 100, 4) AS drift_percent FROM (SELECT DISTINCT phase FROM runs) p LEFT JOIN g ON p.phase = g.phase"""
)
def st_drift(spark, d):
    return stats.drift(rated(spark, d), "decode_tokens_per_second", "seq", "phase").withColumn("drift_percent", F.round("drift_percent", 4))


@query(
    f"""WITH {RUNS}, g AS (SELECT phase, count(*) AS requests, CAST(sum(prompt_tokens) AS BIGINT) AS total_prompt_tokens, CAST(sum(output_tokens) AS BIGINT) AS total_output_tokens,
      count(*) FILTER (done_reason = 'length') AS length_limited_requests, max(started + wall_seconds) - min(started) AS wall FROM runs GROUP BY phase)
    SELECT * EXCLUDE (wall), round(total_output_tokens / wall, 6) AS aggregate_output_tokens_per_second, round(requests / wall, 6) AS requests_per_second FROM g"""
)
def st_throughput(spark, d):
    return r6(stats.generation_summary(tables.runs(spark, d), "phase"), "aggregate_output_tokens_per_second", "requests_per_second")


@query(f"WITH {RUNS} SELECT phase, round(avg(wall_seconds) * (max(started) - min(started)) / 3600, 4) AS energy_wh FROM runs GROUP BY phase")
def st_energy(spark, d):
    return stats.energy(tables.runs(spark, d), "wall_seconds", "started", "phase").withColumn("energy_wh", F.round("energy_wh", 4))


@query("SELECT m AS metric, m IN (SELECT event_type FROM events) AS present FROM (VALUES ('click'), ('error'), ('gpu_power_w')) t(m)")
def st_missing(spark, d):
    have = tables.table(spark, d, "events").select(F.col("event_type").alias("metric"))
    return stats.missing(have, ["click", "error", "gpu_power_w"])


def scored(spark, d, scorer: str) -> DataFrame:
    return stats.score(tables.answers(spark, d).withColumn("scorer", F.lit(scorer)))


NORMAL = r"""regexp_replace(trim(regexp_replace(lower(regexp_replace(trim({0}, ' ' || chr(10)), '\s+', ' ', 'g')), '^answer\s*:\s*', ''), ' "' || chr(39)), '\.$', '')"""


@query(f"WITH {ANSWERS} SELECT case_id, trim(actual, ' ' || chr(10)) = expected AS passed FROM answers")
def st_score_exact(spark, d):
    return scored(spark, d, "exact").select("case_id", "passed")


@query(f"WITH {ANSWERS} SELECT case_id, {NORMAL.format('actual')} = {NORMAL.format('expected')} AS passed FROM answers")
def st_score_normalized(spark, d):
    return scored(spark, d, "normalized").select("case_id", "passed")


@query(f"WITH {ANSWERS}, s AS (SELECT category, {NORMAL.format('actual')} = {NORMAL.format('expected')} AS p FROM answers) SELECT category, count(*) FILTER (p) AS passed, count(*) AS total, round(100.0::DOUBLE * count(*) FILTER (p) / count(*), 6) AS accuracy_percent FROM s GROUP BY ROLLUP (category)")
def st_accuracy(spark, d):
    return r6(stats.accuracy(scored(spark, d, "normalized")), "accuracy_percent")


@query("SELECT event_id AS case_id, event_id % 4 <> 3 AS passed, CASE WHEN event_id % 4 = 3 THEN 'response was not solely a numeric answer' END AS detail FROM events")
def st_score_number(spark, d):
    e = tables.table(spark, d, "events")
    n = F.col("event_id").cast("string")
    forms = [F.concat(F.lit(" Answer: "), n, F.lit(".")), F.concat(n, F.lit(".0!")), F.concat(F.lit("+"), n, F.lit("\n")), F.concat(n, F.lit(" apples"))]
    actual = F.when(F.col("event_id") % 4 == 0, forms[0]).when(F.col("event_id") % 4 == 1, forms[1]).when(F.col("event_id") % 4 == 2, forms[2]).otherwise(forms[3])
    rows = e.select(F.col("event_id").alias("case_id"), F.lit("number").alias("scorer"), n.alias("expected"), actual.alias("actual"))
    return stats.score(rows).select("case_id", "passed", "detail")


@query("SELECT event_id AS case_id, event_id % 3 = 0 AS passed, CASE WHEN event_id % 3 = 2 THEN 'invalid JSON' END AS detail FROM events")
def st_score_json(spark, d):
    e = tables.table(spark, d, "events")
    n = F.col("event_id").cast("string")
    same = F.concat(F.lit('{ "b": [1, true], "a": '), n, F.lit("}"))
    actual = F.when(F.col("event_id") % 3 == 0, same).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"a": '), n, F.lit("}"))).otherwise("{oops")
    rows = e.select(F.col("event_id").alias("case_id"), F.lit("json").alias("scorer"), F.concat(F.lit('{"a": '), n, F.lit(', "b": [1, true]}')).alias("expected"), actual.alias("actual"))
    return stats.score(rows).select("case_id", "passed", "detail")


@query(
    """WITH c AS (SELECT item_id AS seq, (item_id * 37) % 6000 + 100 AS words, (item_id % 10) / 10.0::DOUBLE AS position, CASE item_id % 3 WHEN 0 THEN 0.15::DOUBLE WHEN 1 THEN 0.4::DOUBLE ELSE 0.7::DOUBLE END AS fraction FROM benchmark),
    t AS (SELECT *, CAST(least(words, floor(8192 * fraction)) AS INT) AS target FROM c QUALIFY row_number() OVER (PARTITION BY CAST(least(words, floor(8192 * fraction)) AS INT) ORDER BY seq) = 1),
    n AS (SELECT *, CAST(ceil(greatest(target - 60, 1) / 4.0) AS INT) * 4 AS n FROM t)
    SELECT seq, target, n + 7 AS prompt_words, CAST(floor(n * position) AS INT) AS words_before FROM n WHERE target >= 128"""
)
def st_context_prompt(spark, d):
    """A context case for each item of the benchmark: targets are admitted once, and the record stands at its share of the words."""
    i = F.col("item_id")
    fraction = F.when(i % 3 == 0, 0.15).when(i % 3 == 1, 0.4).otherwise(0.7)
    asked = tables.table(spark, d, "benchmark").select(i.alias("seq"), ((i * 37) % 6000 + 100).cast("int").alias("words"), ((i % 10) / 10.0).alias("position"), F.concat(F.lit("C-"), i.cast("string")).alias("code"), fraction.alias("fraction"))
    c = stats.context_cases(asked, 8192)
    body = F.split(F.split_part(stats.context_prompt(F.col("target"), F.col("position"), F.col("code")), F.lit("\n\n"), F.lit(2)), " ")
    return c.select("seq", "target", F.size(body).alias("prompt_words"), (F.array_position(body, stats.RECORD[0]) - 1).cast("int").alias("words_before"))


@query(f"WITH {INV} SELECT id, prompt_tokens + generated_tokens >= 350 AS possible_truncation FROM inv")
def st_truncation(spark, d):
    return tables.invocations(spark, d).select("id", (F.col("prompt_tokens") + F.col("generated_tokens") >= 350).alias("possible_truncation"))



# --- time series --------------------------------------------------------------

AT = "2024-01-15 12:00:00"
SERIES = ("metric", "instance")
IN = "ts > TIMESTAMP '{at}' - INTERVAL {s} SECOND AND ts <= TIMESTAMP '{at}'"
DAY = IN.format(at=AT, s=86400)
STEPS = f"""{SAMPLES}, w AS (SELECT metric, instance, CASE WHEN value < lag(value) OVER s THEN value ELSE value - lag(value) OVER s END AS step FROM samples WHERE {DAY} WINDOW s AS (PARTITION BY metric, instance ORDER BY ts)),
  rates AS (SELECT metric, instance, sum(step) / 86400 AS value FROM w GROUP BY metric, instance HAVING count(*) >= 2)"""


@query(f"WITH {GAUGES} SELECT metric, instance, arg_max(value, ts) AS value FROM samples WHERE {IN.format(at=AT, s=7200)} GROUP BY ALL")
def ts_instant(spark, d):
    return timeseries.instant(tables.gauge_samples(spark, d), AT, SERIES, 7200)


def _rates(spark, d) -> DataFrame:
    return timeseries.rate(tables.counter_samples(spark, d), AT, 86400, SERIES)


@query(f"WITH {STEPS} SELECT metric, instance, round(value, 9) AS value FROM rates")
def ts_rate(spark, d):
    return _rates(spark, d).withColumn("value", F.round("value", 9))


@query(f"WITH {STEPS} SELECT metric, round(sum(value), 9) AS value FROM rates GROUP BY metric")
def ts_sum_by(spark, d):
    return timeseries.sum_by(_rates(spark, d), "metric").withColumn("value", F.round("value", 9))


@query(f"WITH {STEPS} SELECT instance, round(avg(value), 9) AS mean, count(*) AS series FROM rates GROUP BY instance")
def ts_avg_count(spark, d):
    return _rates(spark, d).groupBy("instance").agg(F.round(F.avg("value"), 9).alias("mean"), F.count(F.lit(1)).alias("series"))


@query(
    f"""WITH b(le) AS (VALUES (0.1), (0.25), (0.5), (1), (2.5), (5), (10), (30), (60), (120), (300), ('infinity'::DOUBLE)),
    h AS (SELECT event_type AS metric, le::DOUBLE AS le, CAST(count(*) FILTER (value <= le) AS DOUBLE) AS c FROM events, b WHERE {DAY} GROUP BY ALL),
    l AS (SELECT metric, le, c, coalesce(lag(le) OVER w, 0) AS lo, coalesce(lag(c) OVER w, 0) AS below, max(c) OVER (PARTITION BY metric) AS total FROM h WINDOW w AS (PARTITION BY metric ORDER BY le)),
    f AS (SELECT metric, min(le) AS le FROM l WHERE c >= 0.95::DOUBLE * total GROUP BY metric)
    SELECT metric, round(CASE WHEN total <= 0 THEN NULL WHEN le = 'infinity'::DOUBLE THEN lo ELSE lo + (le - lo) * (0.95::DOUBLE * total - below) / (c - below) END, 6) AS value FROM l JOIN f USING (metric, le)"""
)
def ts_hist_quantile(spark, d):
    from telemill.schemas import BUCKETS

    e = timeseries.within(tables.gauge_samples(spark, d), AT, 86400).groupBy("metric").agg(measures.bucket_counts(F.col("value")).alias("b"), F.count(F.lit(1)).alias("n"))
    les = F.array(*[F.lit(b) for b in (*BUCKETS, float("inf"))])
    b = e.select("metric", F.inline(F.arrays_zip(les.alias("le"), F.concat("b", F.array("n")).alias("value")))).withColumn("value", F.col("value").cast("double"))
    return timeseries.histogram_quantile(b, 0.95, "metric").withColumn("value", F.round("value", 6))


@query(f"WITH {INV}, g AS (SELECT model, CAST(status AS VARCHAR) AS status, count(*) / 3600.0::DOUBLE AS v FROM inv WHERE status IS NOT NULL GROUP BY ALL) SELECT model, round(coalesce(sum(v) FILTER (NOT regexp_full_match(status, '2..')), 0) / greatest(sum(v), 0.001), 6) AS value FROM g GROUP BY model")
def ts_error_ratio(spark, d):
    g = finished(spark, d).groupBy("model", F.col("status").cast("string").alias("status")).agg((F.count(F.lit(1)) / 3600).alias("value"))
    return timeseries.error_ratio(g, 0.001, "model").withColumn("value", F.round("value", 6))


@query(f"WITH {STEPS} SELECT a.instance, round(a.value / greatest(b.value, 0.001), 6) AS value FROM rates a JOIN rates b ON a.instance = b.instance AND a.metric = 'click' AND b.metric = 'view'")
def ts_vector_div(spark, d):
    r = _rates(spark, d)
    pick = lambda m: r.filter(F.col("metric") == m).select("instance", "value")
    return timeseries.ratio(pick("click"), pick("view"), ("instance",), 0.001).withColumn("value", F.round("value", 6))


@query(f"WITH {STEPS} SELECT instance, round(max(value) FILTER (metric = 'click'), 9) AS click, round(max(value) FILTER (metric = 'view'), 9) AS view_, round(max(value) FILTER (metric = 'error'), 9) AS error FROM rates WHERE metric IN ('click', 'view', 'error') GROUP BY instance")
def ts_outer_table(spark, d):
    r = _rates(spark, d)
    t = timeseries.outer_table({n: r.filter(F.col("metric") == m) for n, m in (("click", "click"), ("view_", "view"), ("error", "error"))}, "instance")
    return t.select("instance", *[F.round(c, 9).alias(c) for c in ("click", "view_", "error")])


@query(f"WITH {STEPS} SELECT metric, instance FROM rates WHERE metric = 'click' AND instance IN (SELECT instance FROM rates WHERE metric = 'error' AND value > 0)")
def ts_semi(spark, d):
    r = _rates(spark, d)
    return timeseries.also_in(r.filter("metric = 'click'"), r.filter("metric = 'error' and value > 0"), ("instance",)).select("metric", "instance")


@query(
    f"""WITH {GAUGES}, g AS (SELECT unnest(range(0, 25)) AS k), t AS (SELECT TIMESTAMP '{AT}' + INTERVAL 1 HOUR * k AS p FROM g)
    SELECT metric, instance, epoch_us(p) AS "at", arg_max(value, ts) AS value FROM t JOIN samples ON ts <= p AND ts > p - INTERVAL 7200 SECOND GROUP BY ALL"""
)
def ts_step_grid(spark, d):
    return micros(timeseries.step_grid(tables.gauge_samples(spark, d), AT, "2024-01-16 12:00:00", 3600, SERIES, 7200), "at")


@query(
    f"""WITH {SAMPLES}, s AS (SELECT *, lag(value) OVER w AS p, lag(ts) OVER w AS pt FROM samples WHERE ts > TIMESTAMP '{AT}' - INTERVAL 21600 SECOND AND ts <= TIMESTAMP '2024-01-16 12:00:00' WINDOW w AS (PARTITION BY metric, instance ORDER BY ts)),
    t AS (SELECT TIMESTAMP '{AT}' + INTERVAL 1 HOUR * k AS g FROM (SELECT unnest(range(0, 25)) AS k)),
    j AS (SELECT metric, instance, g, CASE WHEN pt > g - INTERVAL 21600 SECOND THEN CASE WHEN value < p THEN value ELSE value - p END ELSE 0 END AS d FROM t JOIN s ON ts <= g AND ts > g - INTERVAL 21600 SECOND)
    SELECT metric, instance, epoch_us(g) AS "at", round(coalesce(sum(d), 0) / 21600, 9) AS value FROM j GROUP BY ALL HAVING count(*) >= 2"""
)
def ts_rate_grid(spark, d):
    g = timeseries.rate_grid(tables.counter_samples(spark, d), AT, "2024-01-16 12:00:00", 3600, 21600, SERIES)
    return micros(g, "at").withColumn("value", F.round("value", 9))


@query(f"WITH {GAUGES} SELECT DISTINCT metric FROM samples")
def ts_label_values(spark, d):
    return timeseries.label_values(tables.gauge_samples(spark, d), "metric")


@query(f"WITH {GAUGES} SELECT metric, instance, value, CASE WHEN value >= 60 THEN 'red' WHEN value >= 20 THEN 'orange' ELSE 'green' END AS band FROM samples WHERE metric <> 'view' AND regexp_full_match(instance, '0|2')")
def ts_threshold(spark, d):
    s = timeseries.matched(tables.gauge_samples(spark, d), metric=("!=", "view"), instance=("=~", "0|2"))
    return s.select("metric", "instance", "value", measures.banded(F.col("value"), [(None, "green"), (20.0, "orange"), (60.0, "red")]).alias("band"))


@query(f"WITH {GAUGES} SELECT metric, arg_max(value, ts) AS value FROM samples WHERE value IS NOT NULL GROUP BY metric")
def ts_last_not_null(spark, d):
    return timeseries.last_not_null(tables.gauge_samples(spark, d), ("metric",))


@query("SELECT CAST(event_id AS DOUBLE) AS ts, value FROM events WHERE event_id % 5 <> 0")
def ts_flat_range(spark, d):
    e = tables.table(spark, d, "events")
    text_value = F.when(F.col("event_id") % 10 == 0, "NaN").when(F.col("event_id") % 5 == 0, "+Inf").otherwise(F.col("value").cast("string"))
    doc = F.format_string('{"status":"success","data":{"result":[{"values":[[%d,"%s"]]}]}}', "event_id", text_value)
    return timeseries.flat_range(e.select(doc.alias("document")))


@query(f"WITH {GAUGES} SELECT metric, instance, CAST({1705320000} - epoch_us(max(ts)) / 1e6 AS DOUBLE) AS age FROM samples GROUP BY ALL")
def ts_age(spark, d):
    g = tables.gauge_samples(spark, d).groupBy("metric", "instance").agg(F.max("ts").alias("t"))
    return g.select("metric", "instance", (F.lit(1705320000) - F.unix_micros("t") / F.lit(1e6)).alias("age"))


# --- alerts and logs ----------------------------------------------------------

RUN = """{g}, c AS (SELECT metric, instance, ts, value > 10 AS firing FROM samples), i AS (SELECT *, sum(CASE WHEN firing THEN 0 ELSE 1 END) OVER (PARTITION BY metric, instance ORDER BY ts) AS island FROM c),
  r AS (SELECT metric, instance, min(ts) AS since, max(ts) AS until, count(*) AS samples FROM i WHERE firing GROUP BY metric, instance, island)""".format(g=GAUGES)


def _conditions(spark, d) -> DataFrame:
    return tables.gauge_samples(spark, d).withColumn("firing", F.col("value") > 10)


@query(f"WITH {RUN} SELECT metric, instance, epoch_us(since) AS since, epoch_us(until) AS until, samples, epoch_us(since) + 7200000000 AS fired_at FROM r WHERE epoch_us(until) - epoch_us(since) >= 7200000000")
def al_for_duration(spark, d):
    return micros(timeseries.alerts(_conditions(spark, d), SERIES, 7200), "since", "until", "fired_at")


@query(
    f"""WITH {RUN}, u AS (SELECT * FROM c WHERE ts <= TIMESTAMP '{AT}'), n AS (SELECT metric, instance, max(ts) FILTER (NOT firing) AS no FROM u GROUP BY ALL)
    SELECT metric, instance, epoch_us(min(ts)) AS since FROM u JOIN n USING (metric, instance) WHERE firing AND (no IS NULL OR ts > no) GROUP BY metric, instance
    HAVING epoch_us(TIMESTAMP '{AT}') - epoch_us(min(ts)) >= 1800000000"""
)
def al_firing(spark, d):
    return micros(timeseries.firing_at(_conditions(spark, d), SERIES, 1800, AT), "since")


@query(
    f"""WITH {GAUGES}, c AS (SELECT metric, instance, ts, value > 85 AS firing FROM samples), i AS (SELECT *, sum(CASE WHEN firing THEN 0 ELSE 1 END) OVER (PARTITION BY metric, instance ORDER BY ts) AS island FROM c),
    r AS (SELECT metric, instance, min(ts) AS since, max(ts) AS until FROM i WHERE firing GROUP BY metric, instance, island)
    SELECT 'GpuSustainedHighTemperature' AS alert, 'warning' AS severity, metric, instance, epoch_us(since) AS since, epoch_us(until) AS until, epoch_us(since) + 600000000 AS fired_at, 'the card is hot' AS summary
    FROM r WHERE epoch_us(until) - epoch_us(since) >= 600000000"""
)
def al_rule(spark, d):
    rule = next(r for r in alerts.RULES if r.name == "GpuSustainedHighTemperature")
    return micros(alerts.evaluate(rule, tables.gauge_samples(spark, d).withColumnRenamed("value", "temperature"), SERIES), "since", "until", "fired_at")


@query(f"WITH {LOGS} SELECT count(*) AS value FROM logs WHERE regexp_matches(line, '(?i)error') AND {IN.format(at=AT, s=604800)}")
def lg_errors(spark, d):
    return logs.count_over(logs.selected(tables.log_lines(spark, d), "(?i)error", source=("=~", ".*")), "2024-01-08 12:00:00", AT)


@query(f"WITH {LOGS} SELECT count(*) AS value FROM logs WHERE regexp_matches(line, '(?i)warning')")
def lg_warnings(spark, d):
    return logs.count_over(logs.selected(tables.log_lines(spark, d), "(?i)warning"), "2020-01-01 00:00:00", "2030-01-01 00:00:00")


@query(f"""WITH {LOGS} SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')) AS "at", coalesce(container, '') AS container, count(*) AS value FROM logs GROUP BY ALL""")
def lg_volume(spark, d):
    return micros(logs.volume(tables.log_lines(spark, d), 21600, "container"), "at")


@query(f"""WITH {LOGS} SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')) AS "at", unit, count(*) AS value FROM logs WHERE source = 'journal' GROUP BY ALL""")
def lg_volume_unit(spark, d):
    return micros(logs.volume(logs.selected(tables.log_lines(spark, d), source=("=", "journal")), 21600, "unit"), "at")


@query(f"WITH {LOGS} SELECT line_id, line FROM logs WHERE source = 'docker' ORDER BY ts DESC, line_id DESC LIMIT 100")
def lg_newest(spark, d):
    return logs.newest(logs.selected(tables.log_lines(spark, d), source=("=", "docker")), 100).select("line_id", "line")


@query(f"WITH {LOGS} SELECT line_id, container FROM logs WHERE container IS NOT NULL AND container <> 'svc3'")
def lg_relabel(spark, d):
    raw = tables.log_lines(spark, d).filter("container is not null").withColumn("raw_container", F.concat(F.lit("/"), "container"))
    return logs.relabelled(raw, "svc3").select("line_id", "container")


@query("SELECT s_name AS address0, 'prober:9115' AS address, s_name AS param_target, s_name AS instance FROM supplier")
def lg_probe_labels(spark, d):
    t = tables.table(spark, d, "supplier").select(F.col("s_name").alias("address0"), F.col("s_name").alias("address"))
    return logs.probe_labels(t, "prober:9115").select("address0", "address", "param_target", "instance")


@query("SELECT c_custkey AS id, replace(replace(replace(c_name || chr(92) || chr(10) || '\"', chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'), '\"', chr(92) || '\"') AS label FROM customer")
def fn_metric_label(spark, d):
    c = tables.table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), text.metric_label(F.concat("c_name", F.lit('\\\n"'))).alias("label"))


# --- streaming twins ----------------------------------------------------------


@query(f"WITH {INV} SELECT model, endpoint, CAST(status AS VARCHAR) AS status, count(*) AS requests FROM inv GROUP BY ALL")
def str_requests(spark, d):
    return twins.collected(twins.request_counts(tables.invocations(twins.Streamed(spark, d, "events"), d)), "complete")


@query(f"""WITH {LOGS}, v AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS t, coalesce(container, '') AS container, count(*) AS value FROM logs GROUP BY ALL)
  SELECT epoch_us(t) AS "at", container, value FROM v WHERE t + INTERVAL 6 HOUR <= (SELECT max(ts) FROM logs)""")
def str_volume(spark, d):
    lines = tables.log_lines(twins.Streamed(spark, d, "events"), d)
    return micros(twins.collected(twins.log_volume(lines, 21600, "container", 0), "append"), "at")


@query(f"WITH {INV} SELECT id, CASE WHEN status >= 400 THEN 'error' ELSE 'completed' END AS state, started, status FROM inv WHERE status IS NOT NULL")
def str_lifecycle(spark, d):
    t = twins.transitions(tables.invocations(twins.Streamed(spark, d, "events"), d))
    return twins.collected(twins.lifecycle(t), "append").select("id", "state", "started", "status")


# --- sinks, moments and panels ------------------------------------------------



@query(f"WITH {INV} SELECT id, id || ':' || state || ':' || coalesce(CAST(CAST(round(duration) AS BIGINT) AS VARCHAR), '') || ':' || length(coalesce(response, '')) AS key, strftime(make_timestamp(CAST(round(started * 1e6) AS BIGINT)), '%Y-%m-%dT%H:%M:%S+00:00') AS at_utc FROM inv")
def fn_change_key(spark, d):
    c = F.col
    whole = F.round(c("duration")).cast("bigint")
    return tables.invocations(spark, d).select("id", moments.change_key(c("id"), c("state"), whole, c("response")).alias("key"), moments.iso_utc(moments.moment(c("started"))).alias("at_utc"))


@query("SELECT s_suppkey AS target, CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE 1 END AS up FROM supplier")
def met_up(spark, d):
    s = tables.table(spark, d, "supplier").withColumns({"version": F.when(F.col("s_suppkey") % 3 != 0, "1"), "state": F.lit("{}")})
    return sinks.up_rows(s.withColumnRenamed("s_suppkey", "target"))


@query(f"WITH {FIN} SELECT model, count(*) AS requests, CASE WHEN model IN ('m1', 'm2') THEN 1 ELSE 0 END AS loaded FROM fin GROUP BY model")
def met_state_join(spark, d):
    loaded = spark.createDataFrame([("m1", 1), ("m2", 1)], "model string, loaded int")
    return sinks.with_state(finished(spark, d).groupBy("model").agg(F.count(F.lit(1)).alias("requests")), loaded)


def panel_samples(spark, d) -> DataFrame:
    """Samples under the panels' names: counters as request totals, gauges as memory."""
    c = tables.counter_samples(spark, d)
    status = F.when(F.col("metric") == "error", "500").otherwise("200")
    requests = c.select(F.lit("ollama_requests_total").alias("metric"), F.create_map(F.lit("model"), F.concat(F.lit("m"), "instance"), F.lit("status"), status, F.lit("kind"), F.col("metric")).alias("labels"), "ts", "value")
    g = tables.gauge_samples(spark, d).filter("metric in ('click', 'view')")
    name = F.when(F.col("metric") == "click", "nvidia_smi_memory_used_bytes").otherwise("nvidia_smi_memory_total_bytes")
    gauges = g.select(name.alias("metric"), F.create_map(F.lit("gpu"), F.col("instance")).alias("labels"), "ts", "value")
    return requests.unionByName(gauges)


def _panel(title: str):
    return next(p for p in PANELS if p.title == title)


NOON = "2024-01-15 12:00:00"


def squeezed(df: DataFrame) -> DataFrame:
    """Times 144 times as dense around noon: a five-minute window then holds half a day of driver samples."""
    t0 = F.unix_micros(F.lit(NOON).cast("timestamp"))
    return df.withColumn("ts", F.timestamp_micros(t0 + F.floor((F.unix_micros("ts") - t0) / 144)))


PANEL_RATES = f"""{SAMPLES}, q AS (SELECT metric, instance, value, to_timestamp_us AS ts FROM (SELECT *, epoch_us(TIMESTAMP '{NOON}') + CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '{NOON}')) / 144.0::DOUBLE) AS BIGINT) AS to_timestamp_us FROM samples)),
  w AS (SELECT metric, instance, CASE WHEN value < lag(value) OVER s THEN value ELSE value - lag(value) OVER s END AS step FROM q
        WHERE ts > epoch_us(TIMESTAMP '{NOON}') - 300000000 AND ts <= epoch_us(TIMESTAMP '{NOON}') WINDOW s AS (PARTITION BY metric, instance ORDER BY ts)),
  rates AS (SELECT metric, instance, sum(step) / 300 AS value FROM w GROUP BY metric, instance HAVING count(*) >= 2)"""


@query(f"WITH {PANEL_RATES} SELECT 'm' || instance AS model, round(sum(value), 6) AS value FROM rates GROUP BY instance")
def pan_request_rate(spark, d):
    return r6(evaluate(_panel("Request rate by model"), squeezed(panel_samples(spark, d)), NOON), "value")


@query(f"WITH {PANEL_RATES} SELECT round(coalesce(sum(value) FILTER (metric = 'error'), 0) / greatest(sum(value), 0.001), 6) AS value FROM rates")
def pan_error_share(spark, d):
    return r6(evaluate(_panel("Error share"), squeezed(panel_samples(spark, d)), NOON), "value")


@query(
    f"""WITH g AS (SELECT event_type, user_id % 3 AS gpu, value, epoch_us(TIMESTAMP '{NOON}') + CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '{NOON}')) / 144.0::DOUBLE) AS BIGINT) AS t FROM events WHERE event_type IN ('click', 'view')),
    n AS (SELECT event_type, gpu, arg_max(value, t) AS v FROM g WHERE t > epoch_us(TIMESTAMP '{NOON}') - 300000000 AND t <= epoch_us(TIMESTAMP '{NOON}') GROUP BY ALL)
    SELECT round(a.v / greatest(b.v, 1), 6) AS value FROM n a JOIN n b USING (gpu) WHERE a.event_type = 'click' AND b.event_type = 'view'"""
)
def pan_vram_share(spark, d):
    return r6(evaluate(_panel("VRAM share"), squeezed(panel_samples(spark, d)), NOON), "value")


from telemill.plans import coverage, durable, labels, live, ranges, stored, streams  # noqa: E402, F401  they register more
