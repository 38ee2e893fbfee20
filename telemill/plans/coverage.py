"""Queries over sinks, reports, raw inputs, rules and panels that the other modules leave out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telemill.cases import CASES, cases
from telemill.functions import measures, moments
from telemill.operators import alerts, history, metrics, sinks, stats, timeseries
from telemill.operators.history import Search
from telemill.plans.dashboards import Panel, evaluate
from telemill.plans.registry import micros, query, r6
from telemill.plans.sql import FIN, GAUGES, INV, RUNS
from telemill.sources import readers, tables
from telemill.sources.scratch import folder

# --- history ------------------------------------------------------------------


@query(
    f"""WITH {INV}, p AS (SELECT * FROM inv WHERE state = 'error' ORDER BY started DESC, id LIMIT 50), a AS (SELECT * FROM inv WHERE state = 'error')
    SELECT (SELECT count(*) FROM p) AS n_rows, (SELECT string_agg(id, ',' ORDER BY started DESC, id) FROM p) AS ids, (SELECT count(*) FROM a) AS requests, (SELECT count(*) FROM a WHERE state = 'running') AS running,
      (SELECT count(*) FROM a WHERE state IN ('error', 'interrupted')) AS errors, (SELECT CAST(sum(generated_tokens) AS BIGINT) FROM a) AS generated_tokens,
      (SELECT string_agg(model, ',' ORDER BY model) FROM (SELECT DISTINCT model FROM inv)) AS models, (SELECT string_agg(source, ',' ORDER BY source) FROM (SELECT DISTINCT source FROM inv)) AS sources, 30 AS retention_days,
      (SELECT string_agg(preview, ',' ORDER BY started DESC, id) FROM (SELECT substr(request, 1, 200) AS preview, started, id FROM p)) AS previews"""
)
def inv_document(spark, d):
    """The API document, read back from its JSON."""
    doc = history.api_document(tables.invocations(spark, d), Search(state="error"))
    kind = "struct<rows: array<struct<id: string, preview: string>>, stats: struct<requests: bigint, running: bigint, errors: bigint, generated_tokens: bigint>, models: array<string>, sources: array<string>, retention_days: int>"
    v = doc.select(F.from_json("document", kind).alias("v"))
    joined = lambda c: F.array_join(c, ",")
    return v.select(
        F.size("v.rows").cast("bigint").alias("n_rows"),
        joined(F.col("v.rows.id")).alias("ids"),
        "v.stats.requests",
        "v.stats.running",
        "v.stats.errors",
        "v.stats.generated_tokens",
        joined(F.col("v.models")).alias("models"),
        joined(F.col("v.sources")).alias("sources"),
        "v.retention_days",
        joined(F.col("v.rows.preview")).alias("previews"),
    )


@query(f"WITH {INV} SELECT id, started, model, endpoint, status, prompt_tokens, request, response, truncated, error FROM inv WHERE id = '42'")
def inv_download(spark, d):
    """One record's JSON, read back; nulls are kept."""
    doc = sinks.download(tables.invocations(spark, d).drop("finish_seq"), "42")
    kind = "struct<id: string, started: double, model: string, endpoint: string, status: int, prompt_tokens: bigint, request: string, response: string, truncated: boolean, error: string>"
    return doc.select(F.from_json("document", kind).alias("v")).select("v.*")


STATS = "count(*) AS requests, count(*) FILTER (state IN ('error', 'interrupted')) AS errors, round(avg(duration), 6) AS average_duration"
NOW = 1705320000.0


@query(f"WITH {INV} SELECT hours, {STATS} FROM inv, (VALUES (1), (24), (168), (NULL)) p(hours) WHERE inv.started >= CASE WHEN hours IS NULL THEN 0 ELSE {NOW}::DOUBLE - hours * 3600 END GROUP BY hours")
def inv_preset(spark, d):
    """Statistics within each time preset of the page."""
    out = None
    for hours in (1, 24, 168, None):
        one = history.statistics(tables.invocations(spark, d), Search(since=history.preset_since(NOW, hours))).select(F.lit(hours).cast("int").alias("hours"), "requests", "errors", F.round("average_duration", 6).alias("average_duration"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {INV} SELECT id, started, state FROM inv WHERE model = 'm4' AND started >= 1704500000 AND instr(lower(coalesce(request, '') || coalesce(response, '') || source || purpose), 'view') > 0 ORDER BY started DESC, id LIMIT 50 OFFSET 10")
def inv_params(spark, d):
    """A page from query-string parameters: first values count, unknown ones are ignored."""
    s = Search.of({"q": ["VIEW"], "model": ["m4", "m5"], "since": ["1704500000"], "offset": ["10"], "page": ["9"]})
    return history.page(tables.invocations(spark, d), s).select("id", "started", "state")


@query(f"WITH {INV} SELECT id, started, model, endpoint, source, purpose, 'running' AS state FROM inv WHERE event_day(started) = 5".replace("event_day(started)", "CAST(floor(started / 86400) AS BIGINT) % 7"))
def inv_inserted(spark, d):
    """Rows as they are inserted when a request begins: running, without an outcome."""
    inv = tables.invocations(spark, d).filter(F.floor(F.col("started") / 86400) % 7 == 5)
    return history.folded(inv, inv.limit(0)).filter("status is null and response is null").select("id", "started", "model", "endpoint", "source", "purpose", "state")


@query(f"WITH {INV} SELECT * EXCLUDE (response, finish_seq) FROM inv")
def inv_measurement(spark, d):
    """A record's measurement: all but the response's text."""
    return history.measurement(tables.invocations(spark, d).drop("finish_seq"))


# --- metrics ------------------------------------------------------------------


def finished(spark, d) -> DataFrame:
    from telemill.plans.queries import finished as rows

    return rows(spark, d)


@query(
    f"""WITH {INV} SELECT id, 'ollama_request' AS event, source, purpose, model, endpoint, status, round(duration, 6) AS duration_seconds,
      coalesce(prompt_tokens, 0) AS prompt_tokens, coalesce(generated_tokens, 0) AS generated_tokens FROM inv"""
)
def met_request_log(spark, d):
    """The request log's JSON lines, read back."""
    kind = "struct<event: string, request_id: string, source: string, purpose: string, model: string, endpoint: string, status: int, duration_seconds: double, prompt_tokens: bigint, generated_tokens: bigint>"
    v = metrics.request_log(tables.invocations(spark, d)).select(F.from_json("line", kind).alias("v")).select("v.*")
    return v.withColumnRenamed("request_id", "id")


_BOUNDS = "('0.1', 0.1), ('0.25', 0.25), ('0.5', 0.5), ('1', 1), ('2.5', 2.5), ('5', 5), ('10', 10), ('30', 30), ('60', 60), ('120', 120), ('300', 300), ('+Inf', 'infinity'::DOUBLE)"
_LABELS = "'{{model=\"' || model || '\",endpoint=\"' || endpoint || '\"'"


@query(
    f"""WITH {FIN}, r AS (SELECT model, endpoint, round(duration, 3) AS v FROM fin WHERE duration IS NOT NULL), b(le, bound) AS (VALUES {_BOUNDS}),
    h AS (SELECT model, endpoint, le, count(*) FILTER (v <= bound::DOUBLE) AS n FROM r, b GROUP BY ALL), t AS (SELECT model, endpoint, count(*) AS n, round(sum(v), 3) AS s FROM r GROUP BY ALL),
    m AS (SELECT model, CAST(sum(coalesce(prompt_tokens, 0)) AS BIGINT) AS p, CAST(sum(coalesce(generated_tokens, 0)) AS BIGINT) AS g, arg_max(coalesce(generated_tokens, 0) / (eval_ns / 1e9), finish_seq) FILTER (has_eval_ns AND eval_ns <> 0) AS rate FROM fin GROUP BY model),
    l AS (SELECT 'ollama_request_duration_seconds_bucket{{model="' || model || '",endpoint="' || endpoint || '",le="' || le || '"}} ' || n AS line FROM h
    UNION ALL SELECT 'ollama_request_duration_seconds_sum{{model="' || model || '",endpoint="' || endpoint || '"}} ' || format('{{:.9g}}', s) FROM t
    UNION ALL SELECT 'ollama_request_duration_seconds_count{{model="' || model || '",endpoint="' || endpoint || '"}} ' || n FROM t
    UNION ALL SELECT 'ollama_prompt_tokens_total{{model="' || model || '"}} ' || p FROM m UNION ALL SELECT 'ollama_generated_tokens_total{{model="' || model || '"}} ' || g FROM m
    UNION ALL SELECT 'ollama_last_decode_tokens_per_second{{model="' || model || '"}} ' || format('{{:.9g}}', rate) FROM m WHERE rate IS NOT NULL
    UNION ALL SELECT 'ollama_active_requests ' || count(*) FILTER (state = 'running') FROM inv
    UNION ALL SELECT 'ollama_requests_total{{model="' || model || '",endpoint="' || endpoint || '",status="' || status || '"}} ' || n FROM (SELECT model, endpoint, CAST(status AS VARCHAR) AS status, count(*) AS n FROM fin GROUP BY ALL)
    UNION ALL SELECT * FROM (VALUES ('# HELP ollama_active_requests Requests in work.'), ('# TYPE ollama_active_requests gauge'), ('# TYPE ollama_requests_total counter'), ('# TYPE ollama_prompt_tokens_total counter'),
      ('# TYPE ollama_generated_tokens_total counter'), ('# TYPE ollama_last_decode_tokens_per_second gauge'), ('# TYPE ollama_request_duration_seconds histogram')))
    SELECT line FROM l"""
)
def met_exposition_all(spark, d):
    """The whole text: counters, gauges and histograms with their buckets, sums and counts, and the lines about them."""
    f = finished(spark, d)
    totals, last = metrics.token_totals(f), metrics.last_rates(f).filter("last_decode is not null")
    seconds = f.withColumn("seconds", F.round("duration", 3))
    h = metrics.histogram(seconds, "seconds").withColumn("sum", F.round("sum", 3))
    active = metrics.active_now(tables.invocations(spark, d))
    return metrics.exposition_text(
        {
            "ollama_active_requests": ("gauge", metrics.series(active, "active")),
            "ollama_requests_total": ("counter", metrics.series(metrics.request_counts(f), "requests", "model", "endpoint", "status")),
            "ollama_prompt_tokens_total": ("counter", metrics.series(totals, "prompt_tokens", "model")),
            "ollama_generated_tokens_total": ("counter", metrics.series(totals, "generated_tokens", "model")),
            "ollama_last_decode_tokens_per_second": ("gauge", metrics.series(last, "last_decode", "model")),
            "ollama_request_duration_seconds": ("histogram", metrics.histogram_series(h, "model", "endpoint")),
        },
        {"ollama_active_requests": "Requests in work."},
    ).select("line")


_DIGITS = "concat(CASE WHEN event_id % 2 = 0 THEN '' ELSE '-' END, CAST(event_id * 7919 % 1000003 AS {0}), 'e', CAST(event_id % 31 - 20 AS {0}))"


@query(f"SELECT event_id AS id, format('{{:.9g}}', CAST({_DIGITS.format('VARCHAR')} AS DOUBLE)) AS text FROM events")
def fn_general_number(spark, d):
    """Doubles as %.9g writes them, over 31 orders of magnitude."""
    e = tables.table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), metrics.general_number(F.expr(_DIGITS.format("STRING")).cast("double")).alias("text"))


@query("SELECT count(*) AS n, count(*) AS distinct_ids, true AS well_formed FROM events")
def fn_new_id(spark, d):
    """Random identifiers: as many different ones as rows, each of 32 hex digits."""
    ids = tables.table(spark, d, "events").select(moments.new_id().alias("id"))
    one = ids.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return one.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("distinct_ids"), F.bool_and(F.col("id").rlike(r"\A[0-9a-f]{32}\z")).alias("well_formed"))


@query("SELECT p_name AS name, p_size AS size FROM part WHERE p_name = (SELECT min(p_name) FROM part) LIMIT 1")
def met_first_named(spark, d):
    """The entry of a list that has a name."""
    p = tables.table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    return sinks.first_named(p, p.agg(F.min("name")).scalar())


# --- raw inputs ---------------------------------------------------------------


@query("SELECT 'Mem' || p_size AS name, CAST(p_partkey AS DOUBLE) / 1024 / 1024 AS gib FROM part")
def src_meminfo(spark, d):
    """Host memory lines; lines of another form say nothing."""
    p = tables.table(spark, d, "part")
    good = p.select(F.format_string("Mem%d:   %d kB", "p_size", "p_partkey").alias("value"))
    return readers.meminfo(good.union(p.select(F.lit("HugePages_Total:   0").alias("value"))))


@query("SELECT s_name AS name, CAST(s_nationkey AS VARCHAR) AS driver_version, s_suppkey || ' MiB' AS memory_total, (s_suppkey % 400) || ' W' AS power_limit FROM supplier")
def src_cards(spark, d):
    """Device rows of comma-separated text."""
    s = tables.table(spark, d, "supplier")
    return readers.card_rows(s.select(F.format_string("%s, %d, %d MiB,  %d W", "s_name", "s_nationkey", "s_suppkey", (F.col("s_suppkey") % 400)).alias("value")))


_SCRAPED = "CASE WHEN event_type IN ('click', 'view') THEN 'gpu' ELSE 'node' END"


@query(f"SELECT {_SCRAPED} AS job, event_type AS metric, CAST(user_id % 3 AS VARCHAR) AS instance, count(*) AS samples, max(value) AS most FROM events WHERE {_SCRAPED} = 'gpu' GROUP BY ALL")
def src_samples(spark, d):
    """Scraped samples written by job; those of one job are read back with their labels."""
    g = tables.gauge_samples(spark, d).withColumn("job", F.when(F.col("metric").isin("click", "view"), "gpu").otherwise("node"))
    home = folder(spark, "samples")
    sinks.write_samples(g.select("metric", F.create_map(F.lit("instance"), F.col("instance")).alias("labels"), "ts", "value", "job"), home)
    return readers.samples(spark, home, "gpu").groupBy("job", "metric", F.col("labels")["instance"].alias("instance")).agg(F.count(F.lit(1)).alias("samples"), F.max("value").alias("most"))


@query("SELECT event_type, count(*) AS lines, CAST(sum(event_id) AS BIGINT) AS total, true AS in_order FROM events GROUP BY ALL")
def src_lines(spark, d):
    """Lines of text files in the order of each file."""
    e = tables.table(spark, d, "events").select(F.to_json(F.struct("event_id", "event_type")).alias("value"), "event_id")
    home = folder(spark, "lines")
    e.repartitionByRange(4, "event_id").sortWithinPartitions("event_id").select("value").write.text(home)
    n = F.get_json_object("line", "$.event_id").cast("long")
    lines = readers.ndjson_lines(spark, home).withColumns({"n": n, "event_type": F.get_json_object("line", "$.event_type")})
    before = F.lag("n").over(Window.partitionBy("id").orderBy("seq"))
    lines = lines.withColumn("rises", F.coalesce(F.col("n") > before, F.lit(True)))
    return lines.groupBy("event_type").agg(F.count(F.lit(1)).alias("lines"), F.sum("n").alias("total"), F.bool_and("rises").alias("in_order"))


@query("SELECT CAST(s_suppkey % 7 AS VARCHAR) AS target, count(*) AS probes, round(avg(CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE 1 END), 6) AS success FROM supplier GROUP BY ALL")
def src_probes(spark, d):
    """HTTP probes: a failure of any kind is a 0."""
    s = tables.table(spark, d, "supplier")
    status = F.when(F.col("s_suppkey") % 3 != 0, 200).when(F.col("s_suppkey") % 2 == 0, 503)
    return readers.probe_samples(s.select((F.col("s_suppkey") % 7).cast("string").alias("target"), status.alias("status"))).groupBy("target").agg(F.count(F.lit(1)).alias("probes"), F.round(F.avg("value"), 6).alias("success"))


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS lines, count(*) FILTER (user_id % 2 = 0) AS docker FROM events GROUP BY ALL")
def lg_push(spark, d):
    """Lines appended to the log table, by day."""
    home = folder(spark, "logs")
    lines = tables.log_lines(spark, d)
    half = F.col("line_id") % 2 == 0
    sinks.append_logs(lines.filter(half), home)
    sinks.append_logs(lines.filter(~half), home)
    return spark.read.schema(lines.schema.add("day", "date")).parquet(home).groupBy("day").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("source") == "docker").alias("docker"))


# --- reports ------------------------------------------------------------------

FIELDS = ("wall_seconds", "ttft", "decode_tokens_per_second", "wall_tokens_per_second_after_first_token", "end_to_end_tokens_per_second", "prompt_tokens_per_second")
RATED = f"""{RUNS}, rated AS (SELECT *, CASE WHEN decode_seconds > 0 THEN output_tokens / decode_seconds END AS decode_tokens_per_second,
  CASE WHEN wall_seconds - ttft > 0 THEN greatest(output_tokens - 1, 0) / (wall_seconds - ttft) END AS wall_tokens_per_second_after_first_token,
  CASE WHEN wall_seconds > 0 THEN output_tokens / wall_seconds END AS end_to_end_tokens_per_second, CASE WHEN ttft > 0 THEN prompt_tokens / ttft END AS prompt_tokens_per_second FROM runs)"""


def rated(spark, d) -> DataFrame:
    from telemill.plans.queries import rated as rows

    return rows(spark, d)


@query(
    f"WITH {RATED} "
    + " UNION ALL ".join(
        f"""SELECT phase, '{f}' AS field, count({f}) AS count, round(min({f}), 6) AS min, round(avg({f}), 6) AS mean, round(median({f}), 6) AS median, round(quantile_cont({f}, 0.95), 6) AS p95, round(max({f}), 6) AS max,
      round(stddev_samp({f}), 5) AS standard_deviation, round(stddev_samp({f}) / nullif(avg({f}), 0) * 100, 5) AS coefficient_of_variation_percent FROM rated GROUP BY phase"""
        for f in FIELDS
    )
)
def st_distributions(spark, d):
    """The six distributions of each phase's runs, a row each."""
    out = r6(stats.distributions(rated(spark, d), FIELDS, "phase"), "min", "mean", "median", "p95", "max")
    return out.withColumns({c: F.round(c, 5) for c in ("standard_deviation", "coefficient_of_variation_percent")})


@query(
    f"""WITH {RATED}, s AS (SELECT phase, seq, output_tokens / decode_seconds AS v FROM runs WHERE decode_seconds > 0 AND phase = 'click'),
    h AS (SELECT v, row_number() OVER (ORDER BY seq) <= greatest(count(*) OVER () // 2, 1) AS head FROM s), g AS (SELECT avg(v) FILTER (head) AS a, avg(v) FILTER (NOT head) AS b FROM h),
    t AS (SELECT phase, CAST(sum(output_tokens) AS BIGINT) / (max(started + wall_seconds) - min(started)) AS speed, quantile_cont(wall_seconds, 0.95) AS p95 FROM rated GROUP BY phase), w AS (SELECT * FROM rated WHERE phase = 'view')
    SELECT 75.0::DOUBLE AS functional_accuracy_percent, NULL::DOUBLE AS context_retrieval_accuracy_percent, NULL::DOUBLE AS cold_model_load_seconds, NULL::DOUBLE AS cold_request_wall_seconds,
      (SELECT round(median(ttft), 3) FROM w) AS warm_time_to_first_token_median_seconds, (SELECT round(median(decode_tokens_per_second), 3) FROM w) AS warm_decode_tokens_per_second_median,
      (SELECT round(quantile_cont(decode_tokens_per_second, 0.95), 3) FROM w) AS warm_decode_tokens_per_second_p95, (SELECT round(speed, 3) FROM t WHERE phase = 'click') AS sustained_aggregate_tokens_per_second,
      (SELECT round((b - a) / a * 100, 3) FROM g) AS sustained_decode_speed_drift_percent, (SELECT round(speed, 3) FROM t WHERE phase = 'purchase') AS concurrent_aggregate_tokens_per_second,
      (SELECT round(p95, 3) FROM t WHERE phase = 'purchase') AS concurrent_latency_p95_seconds, false AS full_gpu_offload"""
)
def st_headline(spark, d):
    """The twelve numbers of a report, rounded: no context section, and a cold start that was not confirmed."""
    rows = rated(spark, d)
    phase = lambda p: rows.filter(F.col("phase") == p)
    scored = spark.createDataFrame([("a", True), ("a", True), ("b", True), ("b", False)], "category string, passed boolean")
    return stats.rounded(
        stats.headline(
            accuracy=stats.accuracy(scored).filter("category is null"),
            cold=rows.filter("seq = 1 and phase = 'view'").select(F.col("ttft").alias("load_seconds"), "wall_seconds", F.lit(False).alias("model_was_confirmed_unloaded")),
            warm=stats.distributions(phase("view"), FIELDS),
            sustained=stats.generation_summary(phase("click")).crossJoin(stats.drift(phase("click"), "decode_tokens_per_second", "seq", "phase").select("drift_percent")),  # two one-row frames
            concurrent=(stats.generation_summary(phase("purchase")), stats.distributions(phase("purchase"), FIELDS)),
            deployment=spark.createDataFrame([(10, 9)], "size long, vram long").select(measures.fully_offloaded(F.col("vram"), F.col("size")).alias("full_gpu_offload")),
        )
    )


@query(
    f"""WITH {RUNS}, g AS (SELECT phase, count(*) AS requests, CAST(sum(output_tokens) AS BIGINT) AS tokens, max(started + wall_seconds) - min(started) AS wall FROM runs GROUP BY phase)
    SELECT phase, requests, round(tokens / wall, 3) AS speed FROM g"""
)
def st_report(spark, d):
    """A report's section as JSON with rounded numbers, read back."""
    rows = stats.generation_summary(tables.runs(spark, d), "phase")
    doc = stats.report({"phases": rows.select("phase", "requests", F.col("aggregate_output_tokens_per_second").alias("speed"))})
    kind = "struct<phases: array<struct<phase: string, requests: bigint, speed: double>>>"
    return doc.select(F.explode(F.from_json("document", kind)["phases"]).alias("r")).select("r.*")


@query(
    """WITH c AS (SELECT item_id, 'cat' || item_id % 3 AS category, CAST(item_id * 7 AS VARCHAR) AS expected, item_id % 5 AS k FROM benchmark)
    SELECT category, count(*) FILTER (k IN (0, 1)) AS passed, count(*) AS total, round(100.0::DOUBLE * count(*) FILTER (k IN (0, 1)) / count(*), 6) AS accuracy_percent, count(*) FILTER (k = 4) AS unanswered FROM c GROUP BY ROLLUP (category)"""
)
def st_cases(spark, d):
    """Scored cases written as JSON lines, read, and joined to what was answered; a case without an answer fails."""
    b = tables.table(spark, d, "benchmark")
    home = folder(spark, "cases")
    want = (F.col("item_id") * 7).cast("string")
    b.select(F.col("item_id").cast("string").alias("case_id"), F.concat(F.lit("cat"), (F.col("item_id") % 3).cast("string")).alias("category"), F.concat(F.lit("seven times "), "item_id").alias("prompt"), want.alias("expected"), F.lit("number").alias("scorer")).write.json(home)
    k = F.col("item_id") % 5
    answers = b.filter(k != 4).select(F.col("item_id").cast("string").alias("case_id"), F.when(k == 0, want).when(k == 1, F.concat(F.lit("Answer: "), want, F.lit("."))).when(k == 2, F.concat(want, F.lit(" or so"))).otherwise("0.5").alias("actual"))
    out = stats.measured_cases(readers.quality_cases(spark, home), answers)
    total = stats.accuracy(out).alias("t")
    missing = out.rollup("category").agg(F.count_if(F.col("actual").isNull()).alias("unanswered")).alias("m")
    both = total.join(missing, F.col("t.category").eqNullSafe(F.col("m.category")))
    return r6(both.select("t.category", "passed", "total", "accuracy_percent", "unanswered"), "accuracy_percent")


_ORDER = ", ".join(f"({i}, '{c[1]}')" for i, c in enumerate(CASES))


@query(
    f"""WITH a AS (SELECT category, (item_id // {len(CASES)}) % 4 <> 3 AS passed FROM benchmark JOIN (VALUES {_ORDER}) t(i, category) ON item_id % {len(CASES)} = i)
    SELECT category, count(*) FILTER (passed) AS passed, count(*) AS total, round(100.0::DOUBLE * count(*) FILTER (passed) / count(*), 6) AS accuracy_percent FROM a GROUP BY ROLLUP (category)"""
)
def st_quality_cases(spark, d):
    """Each item of the benchmark asks one of the quality cases; answers come in three good spellings and a bad one in turn."""
    place = spark.createDataFrame([(c[0], i) for i, c in enumerate(CASES)], "name string, i int")  # twenty rows
    b = tables.table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("item"), (F.col("item_id") % len(CASES)).alias("i"), (F.floor(F.col("item_id") / len(CASES)) % 4).alias("k"))
    asked = b.join(place, "i").join(cases(spark).withColumnRenamed("case_id", "name"), "name").select(F.col("item").alias("case_id"), "category", "prompt", "expected", "scorer", "k")
    x, k = F.col("expected"), F.col("k")
    loose = F.col("scorer").isin("number", "normalized")
    said = F.when(k == 0, x).when(k == 1, F.when(loose, F.concat(F.lit("Answer: "), x)).otherwise(F.concat(F.lit(" "), x))).when(k == 2, F.when(loose, F.concat(x, F.lit("."))).otherwise(F.concat(x, F.lit("\n")))).otherwise("none of these")
    return r6(stats.accuracy(stats.measured_cases(asked.drop("k"), asked.select("case_id", said.alias("actual")))), "accuracy_percent")


@query(
    f"""WITH {RUNS} SELECT phase, (seq - 1) // 100 AS page, CAST(count(*) AS BIGINT) AS runs, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, min(seq) AS first_seq, max(seq) AS last_seq,
      arg_max(coalesce(prompt_tokens, -1) || ' ' || done_reason, seq) AS last_run FROM runs GROUP BY ALL"""
)
def st_run_list(spark, d):
    """The runs of each phase as arrays of structs, a hundred a page; the arrays are in order."""
    pages = stats.run_list(tables.runs(spark, d), "seq", ("prompt_tokens", "output_tokens", "done_reason", "decode_seconds"), "phase")
    last = F.element_at("runs", -1)
    total = F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["output_tokens"])
    said = F.concat(F.coalesce(last["prompt_tokens"], F.lit(-1)).cast("string"), F.lit(" "), last["done_reason"])
    return pages.select("phase", "page", F.size("runs").cast("long").alias("runs"), total.alias("output_tokens"), F.element_at("runs", 1)["seq"].alias("first_seq"), last["seq"].alias("last_seq"), said.alias("last_run"))


# --- rules --------------------------------------------------------------------

#: What stands for each rule's inputs: expressions over a gauge's value, in both engines.
INPUTS = {
    "probe_success": "CASE WHEN value > 20 THEN 0 ELSE 1 END",
    "up": "CASE WHEN value > 15 THEN 0 ELSE 1 END",
    "size": "value * 0 + 100.0",
    "vram": "100.0 - value / 10",
    "bad_rate": "value / 100",
    "rate": "value * 0 + 1.0",
    "active_requests": "value / 20",
    "used": "60 + value",
    "total": "value * 0 + 100.0",
    "temperature": "value * 3",
    "avail": "30 - value",
    "available": "25 - value",
}
JOBS = {"click": "ollama", "view": "prometheus", "purchase": "loki", "signup": "gpu"}
_JOB = "CASE metric " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in JOBS.items()) + " ELSE 'other' END"


def _rule_sql(r: alerts.Rule) -> str:
    cond = r.condition
    names = ", ".join(f"CAST({INPUTS[i]} AS DOUBLE) AS {i}" for i in r.inputs)
    match = " AND ".join(f"regexp_full_match({label}, '{value}')" if op == "=~" else f"{label} {op} '{value}'" for label, op, value in r.where) or "true"
    summary = "'" + r.summary.replace("{model}", "' || model || '").replace("{job}", "' || job || '") + "'"
    return f"""SELECT '{r.name}' AS alert, '{r.severity}' AS severity, job, model, epoch_us(min(ts)) AS since, epoch_us(max(ts)) AS until, epoch_us(min(ts)) + {r.hold_seconds}000000 AS fired_at, {summary} AS summary FROM
      (SELECT *, sum(CASE WHEN firing THEN 0 ELSE 1 END) OVER (PARTITION BY job, model ORDER BY ts) AS island FROM (SELECT job, model, ts, coalesce({cond}, false) AS firing FROM (SELECT job, model, ts, {names} FROM labelled WHERE {match})))
      WHERE firing GROUP BY job, model, island HAVING epoch_us(max(ts)) - epoch_us(min(ts)) >= {r.hold_seconds}000000"""


@query(f"WITH {GAUGES}, labelled AS (SELECT {_JOB} AS job, 'm' || instance AS model, ts, value FROM samples) " + " UNION ALL ".join(_rule_sql(r) for r in alerts.RULES))
def al_rules(spark, d):
    """Every rule over inputs made from the gauges: its labels, its hold, and the runs that fire it."""
    g = tables.gauge_samples(spark, d).select(F.expr(_JOB).alias("job"), F.concat(F.lit("m"), "instance").alias("model"), "ts", "value")
    out = None
    for rule in alerts.RULES:
        inputs = g.withColumns({i: F.expr(INPUTS[i]).cast("double") for i in rule.inputs})
        one = alerts.evaluate(rule, inputs, ("job", "model"))
        out = one if out is None else out.unionByName(one)
    return micros(out, "since", "until", "fired_at")


# --- panels -------------------------------------------------------------------

NOON = "2024-01-15 12:00:00"
_NOW = f"epoch_us(TIMESTAMP '{NOON}')"
#: Samples so dense that the panels' windows and lookbacks hold half a day of the driver's rows.
DENSE = f"""dense AS (SELECT event_type AS metric, CAST(user_id % 3 AS VARCHAR) AS instance, value, {_NOW} + CAST(floor((epoch_us(ts) - {_NOW}) / 144.0::DOUBLE) AS BIGINT) AS t FROM events),
  latest AS (SELECT metric, instance, arg_max(value, t) AS v FROM dense WHERE t > {_NOW} - 300000000 AND t <= {_NOW} GROUP BY ALL)"""


def dense(spark, d, names: dict[str, str], labels) -> DataFrame:
    """Gauges under the metric names that a panel asks for."""
    from telemill.plans.queries import squeezed

    g = tables.gauge_samples(spark, d).filter(F.col("metric").isin(*names))
    name = F.coalesce(*[F.when(F.col("metric") == k, v) for k, v in names.items()])
    return squeezed(g.select(name.alias("_name"), labels.alias("labels"), "ts", "value").withColumnRenamed("_name", "metric"))


def _one(label: str):
    return F.create_map(F.lit(label), F.col("instance"))


@query(f"WITH {DENSE} SELECT round(1 - a.v / greatest(b.v, 1), 6) AS value FROM latest a JOIN latest b USING (instance) WHERE a.metric = 'click' AND b.metric = 'view'")
def pan_rest(spark, d):
    """A share that is left: one minus a ratio."""
    names = {"click": "node_memory_MemAvailable_bytes", "view": "node_memory_MemTotal_bytes"}
    return r6(evaluate(_panel("Host memory"), dense(spark, d, names, _one("host")), NOON), "value")


@query(f"WITH {DENSE} SELECT round(a.v - b.v, 6) AS value FROM latest a JOIN latest b USING (instance) WHERE a.metric = 'click' AND b.metric = 'view'")
def pan_difference(spark, d):
    names = {"click": "node_memory_SwapTotal_bytes", "view": "node_memory_SwapFree_bytes"}
    return r6(evaluate(_panel("Swap used"), dense(spark, d, names, _one("host")), NOON), "value")


@query(f"WITH {DENSE} SELECT round(1705320000 - v, 6) AS value FROM latest WHERE metric = 'view'")
def pan_age(spark, d):
    return r6(evaluate(_panel("Uptime"), dense(spark, d, {"view": "node_boot_time_seconds"}, _one("host")), NOON), "value")


@query(f"WITH {DENSE} SELECT round(sum(v) / greatest(count(*), 1), 6) AS value FROM latest WHERE metric IN ('click', 'view')")
def pan_up(spark, d):
    labels = F.create_map(F.lit("job"), F.col("metric"), F.lit("instance"), F.col("instance"))
    return r6(evaluate(_panel("Targets healthy"), dense(spark, d, {"click": "up", "view": "up"}, labels), NOON), "value")


@query(f"WITH {DENSE}, n AS (SELECT greatest(count(*), 1) AS n FROM latest WHERE metric IN ('view', 'signup')) SELECT round(v / n, 6) AS value FROM latest, n WHERE metric = 'click' AND instance = '1'")
def pan_per_cpu(spark, d):
    """Load divided by the number of idle counters."""
    names = {"click": "node_load1", "view": "node_cpu_seconds_total", "signup": "node_cpu_seconds_total"}
    labels = F.create_map(F.lit("cpu"), F.concat("metric", "instance"), F.lit("mode"), F.lit("idle"))
    s = dense(spark, d, names, labels)
    return r6(evaluate(_panel("Load 1 a CPU"), s.filter("metric <> 'node_load1' or labels['cpu'] = 'click1'"), NOON), "value")


@query(f"WITH {DENSE} SELECT 'v' || instance AS version, v AS value FROM latest WHERE metric = 'view'")
def pan_info(spark, d):
    """A label carried by an info metric."""
    labels = F.create_map(F.lit("version"), F.concat(F.lit("v"), "instance"), F.lit("host"), F.lit("h"))
    return evaluate(_panel("Version"), dense(spark, d, {"view": "ollama_version_info"}, labels), NOON)


COUNTS = f"""q AS (SELECT user_id % 3 AS m, event_type, value, event_id, {_NOW} + CAST(floor((epoch_us(ts) - {_NOW}) / 144.0::DOUBLE) AS BIGINT) AS t FROM events),
  b(le) AS (VALUES (0.1), (0.25), (0.5), (1), (2.5), (5), (10), (30), (60), (120), (300), ('infinity'::DOUBLE)),
  c AS (SELECT m, le::DOUBLE AS le, t, event_id, CAST(count(*) FILTER (value <= le) OVER (PARTITION BY m, le ORDER BY t, event_id) AS DOUBLE) AS value FROM q, b),
  w AS (SELECT m, le, value - lag(value) OVER (PARTITION BY m, le ORDER BY t, event_id) AS step FROM c WHERE t > {_NOW} - 300000000 AND t <= {_NOW}),
  h AS (SELECT m, le, sum(step) / 300 AS c FROM w GROUP BY m, le HAVING count(*) >= 2),
  l AS (SELECT m, le, c, coalesce(lag(le) OVER x, 0) AS lo, coalesce(lag(c) OVER x, 0) AS below, max(c) OVER (PARTITION BY m) AS total FROM h WINDOW x AS (PARTITION BY m ORDER BY le)),
  f AS (SELECT m, min(le) AS le FROM l WHERE c >= 0.95::DOUBLE * total GROUP BY m)"""


@query(f"WITH {COUNTS} SELECT 'm' || m AS model, round(CASE WHEN total <= 0 THEN NULL WHEN le = 'infinity'::DOUBLE THEN lo ELSE lo + (le - lo) * (0.95::DOUBLE * total - below) / (c - below) END, 6) AS value FROM l JOIN f USING (m, le)")
def pan_p95_duration(spark, d):
    """A quantile over the rates of a histogram's cumulative buckets."""
    from telemill.plans.queries import squeezed

    b = squeezed(tables.bucket_samples(spark, d))
    le = F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.col("le").cast("string"))
    s = b.select(F.lit("ollama_request_duration_seconds_bucket").alias("metric"), F.create_map(F.lit("model"), F.concat(F.lit("m"), "instance"), F.lit("le"), le).alias("labels"), "ts", "value")
    return r6(evaluate(_panel("p95 duration by model"), s, NOON), "value")


@query(f"WITH {DENSE} SELECT 'm' || instance || ' at ' || metric AS legend, metric = 'click' AS click, CASE WHEN metric = 'click' THEN v / 1073741824 ELSE v * 100 END AS scaled FROM latest WHERE metric IN ('click', 'view')")
def pan_legend(spark, d):
    """Legends filled from labels, and values in a panel's unit."""
    v = timeseries.instant(dense(spark, d, {"click": "click", "view": "view"}, _one("instance")).select("metric", F.col("labels")["instance"].alias("instance"), "ts", "value"), NOON, ("metric", "instance"))
    v = v.withColumn("model", F.concat(F.lit("m"), "instance"))
    click = F.col("metric") == "click"
    return v.select(moments.legend("{{model}} at {{metric}}", "model", "metric").alias("legend"), click.alias("click"), F.when(click, measures.scaled(F.col("value"), "gib")).otherwise(measures.scaled(F.col("value"), "percent")).alias("scaled"))


@query(f"WITH {GAUGES} SELECT 'all' AS choice, count(*) AS n FROM samples UNION ALL SELECT 'some', count(*) FROM samples WHERE metric IN ('click', 'error') UNION ALL SELECT 'named', count(*) FROM samples WHERE instance <> '0'")
def ts_multi_select(spark, d):
    """A dashboard variable: all, chosen values, or all that have a value."""
    g = tables.gauge_samples(spark, d)
    named = g.withColumn("instance", F.when(F.col("instance") != "0", F.col("instance")))
    picks = {"all": timeseries.multi_select(g, "metric", None), "some": timeseries.multi_select(g, "metric", ["click", "error"]), "named": timeseries.multi_select(named, "instance", None, needs_value=True)}
    out = None
    for name, df in picks.items():
        one = df.agg(F.lit(name).alias("choice"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def _panel(title: str) -> Panel:
    from telemill.plans.dashboards import PANELS

    return next(p for p in PANELS if p.title == title)


