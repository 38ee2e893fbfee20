"""Golden cases of the operators on small frames."""

import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from telemill.functions import events, text
from telemill.operators import alerts, history, metrics, stats, stream, timeseries
from telemill.operators.history import Search
from telemill.streaming import twins


def lines(spark, rows):
    return spark.createDataFrame(rows, "id string, seq long, line string")


@pytest.mark.parametrize(
    ("event", "want"),
    [
        ({"response": "hello"}, "hello"),
        ({"message": {"content": "hello"}}, "hello"),
        ({"message": {"thinking": "hmm"}}, "hmm"),
        ({"message": {}, "response": "x"}, ""),
        ({"choices": [{"delta": {"reasoning": "hmm"}}]}, "hmm"),
        ({"choices": [{"text": "t", "delta": {"content": "d"}}]}, "t"),
        ({"choices": [{"delta": {}, "message": {"content": "m"}}]}, "m"),
        ({"choices": []}, ""),
        ({"response": "", "thinking": "deep"}, "deep"),
    ],
)
def test_event_text(spark, event, want):
    df = lines(spark, [("a", 0, json.dumps(event))])
    assert stream.texts(df).first()["text"] == want


def test_stream_lines_that_are_no_events(spark):
    rows = ["", "data: [DONE]", "not json", "[1]", "data: {\"done\": true}", "  {\"a\": 1} "]
    got = stream.events(lines(spark, [("a", i, x) for i, x in enumerate(rows)])).orderBy("seq").select(F.col("event").isNotNull().alias("e"), "is_done_mark").collect()
    assert [r["e"] for r in got] == [False, False, False, False, True, True]
    assert [r["is_done_mark"] for r in got] == [False, True, False, False, False, False]


def test_measurement_of_usage_and_of_a_final_record(spark):
    rows = [
        ("u", 0, 'data: {"choices":[],"usage":{"prompt_tokens":17,"completion_tokens":2}}'),
        ("n", 0, '{"response":"hello","done":false}'),
        ("n", 1, '{"done":true,"prompt_eval_count":4,"eval_count":8,"eval_duration":null}'),
        ("e", 0, '{"error":"model missing"}'),
    ]
    got = {r["id"]: r for r in stream.folded(lines(spark, rows)).collect()}
    assert (got["u"]["measurement"]["prompt_tokens"], got["u"]["measurement"]["generated_tokens"]) == (17, 2)
    assert not got["u"]["measurement"]["has_eval_ns"]
    assert got["n"]["measurement"]["generated_tokens"] == 8 and got["n"]["measurement"]["has_eval_ns"]
    assert got["n"]["complete"] and got["n"]["text"] == "hello"
    assert got["e"]["error"] == "model missing" and got["e"]["measurement"] is None


def test_pretty_printed_body_measures(spark):
    fold = stream.folded(lines(spark, [("a", 0, "{"), ("a", 1, '"prompt_eval_count": 3'), ("a", 2, "}")]))
    bodies = spark.createDataFrame([("a", '{\n"prompt_eval_count": 3\n}', False)], "id string, response string, truncated boolean")
    assert stream.with_body_measurement(fold, bodies).first()["measurement"]["prompt_tokens"] == 3


def test_capture_cuts_bytes(spark):
    got = stream.captured(lines(spark, [("a", 0, "abcdé"), ("a", 1, "xyz")]), 5).first()
    assert got["truncated"] and got["response"].startswith("abcd") and len(got["response"]) == 5


def finished(spark, rows):
    return spark.createDataFrame(rows, "model string, endpoint string, status int, duration double, ttft double, prompt_tokens long, generated_tokens long, prompt_ns long, has_prompt_ns boolean, eval_ns long, has_eval_ns boolean, load_ns long, has_load_ns boolean, finish_seq long")


def test_native_measures(spark):
    df = metrics.with_queue(finished(spark, [('model"name', "/api/generate", 200, 2.0, 1.5, 10, 20, 10**9, True, 2 * 10**9, True, 2 * 10**8, True, 1)]))
    assert metrics.last_rates(df).first()["last_decode"] == 10
    h = {r["le"]: r for r in metrics.histogram(df, "queue").collect()}
    assert h["+Inf"]["total"] == 1 and abs(h["+Inf"]["sum"] - 0.3) < 1e-9 and h["0.25"]["count"] == 0 and h["0.5"]["count"] == 1
    assert 'model="model\\"name"' in metrics.exposition(metrics.request_series(df)).first()["line"]


def test_usage_only_has_no_timing(spark):
    df = finished(spark, [("m", "/v1/chat/completions", 200, 1.0, 0.1, 17, 2, None, False, None, False, None, False, 1)])
    t = metrics.token_totals(df).first()
    assert t["prompt_tokens"] == 17 and t["eval_seconds"] is None
    assert metrics.last_rates(df).first()["last_decode"] is None
    assert metrics.histogram(metrics.with_queue(df), "queue").count() == 0


def invocations(spark):
    rows = [("a", 100.0, "m", "agent", "review", "completed", "found a bug"), ("b", 90.0, "m", "agent", None, "completed", "found a bug"), ("c", 1.0, "m", "É", "x", "running", None)]
    return spark.createDataFrame(rows, "id string, started double, model string, source string, purpose string, state string, response string").withColumns({"request": F.lit(None).cast("string"), "duration": F.lit(1.0), "prompt_tokens": F.lit(5), "generated_tokens": F.lit(9)})


def test_search_is_literal_ascii_folded_and_null_safe(spark):
    inv = invocations(spark)
    found = lambda q: {r["id"] for r in history.matching(inv, Search(q=q)).collect()}
    assert found("FOUND A BUG") == {"a"}
    assert found("' OR 1=1 --") == set()
    assert found("é") == set() and found("É") == {"c"}
    assert history.statistics(inv, Search(state="nothing")).first().asDict() == {"requests": 0, "running": 0, "errors": 0, "prompt_tokens": None, "generated_tokens": None, "average_duration": None}
    assert history.matching(inv, Search(since=float("nan"))).count() == 0


def test_parameters():
    assert Search.of({"offset": ["-3"], "q": ["x", "y"]}) == Search(q="x", offset=0)
    for bad in ({"offset": ["invalid"]}, {"since": ["soon"]}, {"offset": [str(1 << 70)]}):
        with pytest.raises(ValueError):
            Search.of(bad)


def test_retention_and_recovery(spark):
    inv = invocations(spark)
    assert {r["id"] for r in history.retained(inv, 95.0 + 86400, 1).collect()} == {"a", "c"}
    assert history.retained(inv, 1e9, 0).count() == 3
    got = {r["id"]: r["state"] for r in history.recovered(inv.withColumn("error", F.lit(None).cast("string")), 50.0).collect()}
    assert got["c"] == "interrupted" and got["a"] == "completed"


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=30))
def test_percentile_is_interpolated(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = stats.percentiles(df, "v", {"p": 0.95}).first()["p"]
    x = sorted(values)
    at = (len(x) - 1) * 0.95
    low = int(at)
    want = x[low] + (x[min(low + 1, len(x) - 1)] - x[low]) * (at - low)
    assert got == pytest.approx(want, rel=1e-9, abs=1e-6)


def test_drift(spark):
    df = spark.createDataFrame([("a", 1, 10.0), ("a", 2, None), ("a", 3, 10.0), ("a", 4, 20.0), ("b", 1, 5.0), ("c", 1, None)], "g string, i int, v double")
    got = {r["g"]: r["drift_percent"] for r in stats.drift(df, "v", "i", "g").collect()}
    assert got == {"a": 50.0, "b": 0.0, "c": None}


@pytest.mark.parametrize(
    ("scorer", "expected", "actual", "passed"),
    [
        ("exact", "a", " a\n", True),
        ("normalized", "Paris", 'Answer:  "PARIS".', False),
        ("normalized", "Paris", " answer: 'paris' ", True),
        ("normalized", "x", "x..", False),
        ("number", "1000", "Answer: 1,000.", True),
        ("number", "1", "1 apple", False),
        ("number", "2.50", "+2.5!", True),
        ("json", '{"a":1,"b":[2]}', '{"b": [2], "a": 1}', True),
        ("json", '{"a":1}', "nope", False),
    ],
)
def test_scorers(spark, scorer, expected, actual, passed):
    df = spark.createDataFrame([(scorer, expected, actual)], "scorer string, expected string, actual string")
    assert stats.score(df).first()["passed"] is passed


def test_unknown_scorer_fails(spark):
    df = spark.createDataFrame([("magic", "a", "a")], "scorer string, expected string, actual string")
    with pytest.raises(Exception, match="unknown scorer"):
        stats.score(df).collect()


def samples(spark, rows):
    return spark.createDataFrame(rows, "s string, t string, value double").select("s", F.to_timestamp("t").alias("ts"), "value")


def test_rate_counts_a_reset_with_its_new_value(spark):
    df = samples(spark, [("a", "2024-01-01 00:00:10", 5.0), ("a", "2024-01-01 00:00:20", 9.0), ("a", "2024-01-01 00:00:30", 2.0), ("b", "2024-01-01 00:00:30", 1.0)])
    got = timeseries.rate(df, "2024-01-01 00:01:00", 60, ("s",)).collect()
    assert [(r["s"], r["value"]) for r in got] == [("a", 0.1)]


def test_quantile_edges(spark):
    df = spark.createDataFrame([("a", 1.0, 0.0), ("a", 2.0, 4.0), ("a", float("inf"), 4.0), ("b", 1.0, 0.0), ("b", float("inf"), 3.0), ("c", 1.0, 0.0), ("c", float("inf"), 0.0)], "g string, le double, value double")
    got = {r["g"]: r["value"] for r in timeseries.histogram_quantile(df, 0.5, "g").collect()}
    assert got == {"a": 1.5, "b": 1.0, "c": None}


def test_label_matchers_are_anchored(spark):
    df = spark.createDataFrame([("200",), ("x200",), ("500",), (None,)], "status string")
    assert {r[0] for r in timeseries.matched(df, status=("!~", "2..")).collect()} == {"x200", "500", None}
    assert df.filter(text.full_match(F.col("status"), "2..")).count() == 1


def test_alert_holds(spark):
    df = samples(spark, [("a", f"2024-01-01 00:0{i}:00", v) for i, v in enumerate([90.0, 90.0, 10.0, 90.0, 90.0, 90.0])])
    c = df.withColumn("firing", F.col("value") > 85)
    got = timeseries.alerts(c, ("s",), 120).collect()
    assert len(got) == 1 and got[0]["samples"] == 3
    assert timeseries.firing_at(c, ("s",), 120, "2024-01-01 00:05:00").count() == 1
    assert timeseries.firing_at(c, ("s",), 121, "2024-01-01 00:05:00").count() == 0
    assert len({r.name for r in alerts.RULES}) == 11


def test_plans(spark):
    """The filter reaches the scan, the page is a top-k, and bodies are not read for statistics."""
    from telemill.plans.queries import QUERIES

    plan = QUERIES["inv_page"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_history_filters_reach_the_scan(spark, tmp_path):
    """On a written history equality and time are pushed down, days are pruned, and statistics read no bodies."""
    from telemill.operators import sinks
    from telemill.sources import readers, tables

    sinks.write_history(tables.invocations(spark, "/root/testdata/sf0.001").drop("finish_seq"), str(tmp_path / "h"))
    inv = readers.invocation_files(spark, str(tmp_path / "h"))
    found = history.statistics(inv, history.Search(model="m3", state="error", since=1705000000.0))
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = found._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "EqualTo(model,m3)" in plan and "EqualTo(state,error)" in plan and "GreaterThanOrEqual(started,1.705E9)" in plan
    read = plan[plan.index("ReadSchema") :]
    assert "request" not in read and "response" not in read
    days = spark.read.parquet(str(tmp_path / "h")).filter("started_date = '2024-01-05'")
    assert "PartitionFilters: [isnotnull(started_date" in days._jdf.queryExecution().executedPlan().toString()


def test_percentiles_of_many_rows_and_groups(spark):
    """Against numpy, with ties, nulls, a null group and a group of nulls."""
    rng = np.random.default_rng(3)
    rows = [(g, float(v)) for g, n in (("a", 20_000), ("b", 3), (None, 500)) for v in rng.integers(0, 3000, n) / 7] + [("a", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    qs = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r["g"]: r for r in stats.percentiles(df, "v", qs, "g").collect()}
    for g in ("a", "b", None):
        own = [v for x, v in rows if x == g and v is not None]
        for name, q in qs.items():
            assert got[g][name] == pytest.approx(np.quantile(own, q))
    s = {r["g"]: r for r in stats.summary(df, "v", "g").collect()}
    assert s["none"]["count"] == 0 and s["none"]["median"] is None and s["a"]["p95"] == got["a"]["p95"]


def test_percentiles_in_rounds(spark, monkeypatch):
    """With room for a few values only, brackets are narrowed by counting; skewed values, heavy ties and tiny ranges included."""
    seen = []
    real = stats._among
    for name, x in (("IN_ORDER", 20), ("PIECES", 8), ("BRACKET", 0.05)):
        monkeypatch.setattr(stats, name, x)
    monkeypatch.setattr(stats, "_among", lambda *a: seen.append(real(*a)) or seen[-1])
    rng = np.random.default_rng(5)
    kinds = {
        "skewed": np.exp(rng.normal(size=30_000) * 4),
        "ties": rng.integers(0, 3, 30_000).astype(float),
        "narrow": 1e6 + rng.integers(0, 20_000, 30_000) * 2.0**-33,
        "one": np.full(20_000, 7.0),
        "few": np.array([3.0, 1.0, 2.0]),
    }
    df = spark.createDataFrame([(k, float(v)) for k, x in kinds.items() for v in x], "g string, v double")
    qs = {"p0": 0.0, "p1": 0.001, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r["g"]: r for r in stats.percentiles(df, "v", qs, "g").collect()}
    assert all(got[k][n] == pytest.approx(np.quantile(x, q), rel=1e-15) for k, x in kinds.items() for n, q in qs.items())
    assert len(seen) >= 4
    in_order = seen[-1].filter("_v is not null").groupBy("g", "_q").agg(F.count_distinct("_v").alias("n"))
    assert in_order.agg(F.max("n")).first()[0] <= 20


def test_neighbours_of_samples_across_days(spark):
    """The sample before and after, over empty days, as one sort of the series gives them."""
    rng = np.random.default_rng(4)
    times = sorted(rng.choice(20 * 86400, 200, replace=False).tolist())
    times = [t for t in times if (t // 86400) % 4 != 2]
    df = spark.createDataFrame([(str(i % 2), 1_700_000_000 + t, float(i)) for i, t in enumerate(times)], "s string, t long, value double").withColumn("ts", F.timestamp_seconds("t"))
    for later in (False, True):
        got = {r["value"]: r["_near"] and r["_near"]["value"] for r in timeseries.beside(df, ("s",), ("value",), later).collect()}
        step = 2 if later else -2
        assert got == {float(i): float(i + step) if 0 <= i + step < len(times) else None for i in range(len(times))}


def test_zero_as_text_is_text(spark):
    """Only empty things add nothing: the text "0" or "false" is a token, the number 0 is none."""
    df = lines(spark, [("a", i, x) for i, x in enumerate(['{"response":"0"}', '{"response":"false"}', '{"response":0}', '{"response":[]}', '{"message":{"content":"","thinking":"null"}}', '{"response":-0.0}'])])
    r = stream.folded(df).first()
    assert r["text"] == "0falsenull" and r["thinking"] == "null" and r["first_seq"] == 0


def test_first_token_time_and_last_error(spark):
    df = spark.createDataFrame([("a", 0, "", 1.0), ("a", 1, '{"error":"one"}', 2.0), ("a", 2, '{"response":"x"}', 3.5), ("a", 3, '{"error":"two"}', 4.0), ("a", 4, '{"error":""}', 5.0)], "id string, seq long, line string, at double")
    r = stream.folded(df).first()
    assert (r["first_at"], r["first_seq"], r["error"], r["events"]) == (3.5, 2, "two", 4)
    bodies = spark.createDataFrame([("a", '{\n"error": "whole"}', False)], "id string, response string, truncated boolean")
    assert stream.with_body_measurement(stream.folded(df), bodies).first()["error"] == "whole"


def test_open_requests_time_out(spark, tmp_path):
    """A request without an end for so long is interrupted; a polling trigger sees to it."""
    import time

    schema = "id string, kind string, at double, status int"
    spark.createDataFrame([("a", "start", 1.0, None), ("b", "start", 2.0, None), ("b", "finish", 3.0, 200)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    seen = str(tmp_path / "out")
    q = twins.lifecycle(rows, limit_ms=500).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").format("parquet").start(seen)
    spark.createDataFrame([("c", "start", 1.0, None)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    try:
        deadline = time.time() + 60
        while time.time() < deadline:
            got = {r["id"]: r["state"] for r in spark.read.schema(twins.LIFECYCLE).parquet(seen).collect()}
            if got.get("a") == "interrupted" and got.get("c") == "interrupted":
                break
            time.sleep(1)
    finally:
        q.stop()
    assert got == {"a": "interrupted", "b": "completed", "c": "interrupted"}


def test_polling_trigger(spark):
    """A stream polled by processing time gives what one run over all gives."""
    counts = twins.request_counts(twins.Streamed(spark, "/root/testdata/sf0.001", "events").parquet("/root/testdata/sf0.001/events.parquet").select(F.col("event_type").alias("model"), F.lit("e").alias("endpoint"), F.lit(200).alias("status")))
    got = twins.collected(counts, "complete", {"processingTime": "1 second"})
    assert got.agg(F.sum("requests")).first()[0] == 1000


def test_guarded_sink_never_raises(spark):
    def broken(batch, number):
        raise OSError("disk full")

    twins.guarded(broken)(spark.range(1), 0)


def test_tool_calls_and_shown_text(spark):
    df = lines(spark, [("a", 0, '{"choices":[{"delta":{}},{"message":{"tool_calls":[1]}}]}'), ("a", 1, '{"message":{"tool_calls":[]}}'), ("a", 2, '{"message":{"content":"c","reasoning":"r"}}')])
    assert [r["seq"] for r in stream.tool_events(df).collect()] == [0]
    t = stream.texts(df).filter("seq = 2").first()
    assert (t["content"], t["thinking"]) == ("c", "r")
    assert events.FIELDS[0] == ("prompt_tokens", "prompt_eval_count")


def test_every_panel_shape(spark):
    from telemill.plans import dashboards

    shapes = {p.shape: p for p in dashboards.PANELS}
    rows = []
    for p in shapes.values():
        for name, rising in ((p.metric, 1.0), (p.other, 2.0)):
            for i in range(4):
                labels = {"mode": "idle", "mountpoint": "/", "device": "nvme0", "model": "m", "status": "200", "le": "+Inf"} if p.shape in ("quantile", "rate", "errors", "busy", "load_cost") or name.endswith("total") else {"mountpoint": "/", "model": "m", "mode": "idle"}
                rows.append((name, labels, f"2024-01-01 00:0{i}:00", rising * (i + 1)))
    df = spark.createDataFrame([r for r in rows if r[0]], "metric string, labels map<string,string>, t string, value double").withColumn("ts", F.to_timestamp("t")).drop("t").dropDuplicates(["metric", "ts"])
    for p in shapes.values():
        assert dashboards.evaluate(p, df, "2024-01-01 00:04:00").count() == 1, p.shape


def test_readers(spark, tmp_path):
    from telemill.sources import readers

    (tmp_path / "a.ndjson").write_text('{"response":"x"}\n{"done":true}')
    assert [r["line"] for r in readers.ndjson_lines(spark, str(tmp_path)).orderBy("seq").collect()] == ['{"response":"x"}', '{"done":true}']
    mem = spark.createDataFrame([("MemTotal:  2097152 kB",), ("junk",)], "value string")
    assert [tuple(r) for r in readers.meminfo(mem).collect()] == [("MemTotal", 2.0)]
    assert readers.card_rows(spark.createDataFrame([("RTX, 1.2, 12288, 350",)], "value string")).first()["memory_total"] == "12288"
    v = spark.createDataFrame([("[1]",), ('{"model":""}',), ('{"model":"q"}',)], "c string").select(readers.model_of(readers.request_payload(F.col("c"))).alias("m"))
    assert [r["m"] for r in v.collect()] == ["unknown", "unknown", "q"]


def test_partitioned_sinks(spark, tmp_path):
    from telemill.operators import sinks

    sinks.write_history(invocations(spark), str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h")).filter("started_date = '1970-01-01'").count() == 3


class Kept:
    """A stand-in for a group's state, at a processing time."""

    def __init__(self):
        self.x, self.now, self.hasTimedOut, self.due = None, 0, False, None

    exists = property(lambda self: self.x is not None)
    get = property(lambda self: self.x)

    def update(self, x):
        self.x = x

    def remove(self):
        self.x = self.due = None

    def getCurrentProcessingTimeMs(self):  # noqa: N802
        return self.now

    def setTimeoutDuration(self, ms):  # noqa: N802
        self.due = self.now + ms


def test_many_requests_are_folded_in_one_call():
    """A group of requests takes one call a batch, and each is what it would be alone."""
    import pandas as pd

    step, state = twins._advance(100), Kept()
    batch = lambda *rows: pd.DataFrame(rows, columns=["id", "kind", "at", "status"])

    def go(now, *frames):
        state.now = now
        return {r[0]: r[1:] for f in step((0,), iter(frames), state) for r in f.astype(object).where(f.notna(), None).itertuples(index=False)}

    assert go(0, batch(("a", "start", 2.0, None), ("b", "start", 3.0, None)), batch(("a", "start", 1.0, None), ("b", "finish", 5.0, 200), ("b", "finish", 4.0, 500), ("c", "finish", 9.0, 500))) == {"b": ("completed", 3.0, 5.0, 200), "c": ("error", None, 9.0, 500)}
    assert state.x == (["a"], [1.0], [0]) and state.due == 100
    assert go(60, batch(("d", "start", 7.0, None), ("e", "start", 8.0, None))) == {} and state.due == 100
    state.hasTimedOut = True
    assert go(100) == {"a": ("interrupted", 1.0, None, None)} and state.due == 160
    state.hasTimedOut = False
    assert go(120, batch(("d", "finish", 7.5, 200), ("e", "finish", 8.5, 200), ("e", "finish", 8.5, 404))) == {"d": ("completed", 7.0, 7.5, 200), "e": ("error", 8.0, 8.5, 404)}
    assert not state.exists


def test_samples_of_the_same_time_do_not_reset_a_counter(spark):
    """Cumulative counts of events at one time are in order of their values, whatever order they are read in."""
    rows = [("a", "2024-01-01 00:00:10", 7.0), ("a", "2024-01-01 00:00:20", 12.0), ("a", "2024-01-01 00:00:20", 9.0), ("a", "2024-01-01 00:00:20", 11.0), ("a", "2024-01-01 00:00:30", 13.0)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "s string, t string, value double").withColumn("ts", F.col("t").cast("timestamp")).coalesce(1)
        assert timeseries.rate(df, "2024-01-01 00:00:40", 60, ("s",)).first()["value"] == 6 / 60
        grid = timeseries.rate_grid(df, "2024-01-01 00:00:40", "2024-01-01 00:00:40", 60, 60, ("s",))
        assert grid.first()["value"] == 6 / 60


def test_bucket_samples_are_made_after_the_running_counts(spark):
    """Windows sort an event once, not once a bound."""
    from telemill.sources import tables

    s = tables.bucket_samples(spark, "/root/testdata/sf0.001")
    plan = s._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and plan.index("Generate") < plan.index("Window")
    assert s.count() == 12 * 1000
