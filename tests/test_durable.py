"""The durable history: replays, cuts, early finishes, changed days only, and retention."""

import os
import re

import pytest
from pyspark.sql import functions as F

from telemill.streaming import durable

DAY = 86400.0
SCHEMA = "id string, started double, model string, endpoint string, source string, purpose string, request string, status int, duration double, ttft double, prompt_tokens long, generated_tokens long, response string, truncated boolean, error string, finish_seq long"


def record(i, started, status=200, seq=1, error=None):
    return (i, started, "m", "/api/chat", "c", "", "{}", status, 1.0, 0.5, 1, 2, "ok", False, error, seq)


@pytest.fixture
def made(spark, tmp_path):
    h = durable.History(spark, f"{tmp_path}/history")
    frame = lambda *rows: spark.createDataFrame(list(rows), SCHEMA)
    return h, frame, f"{tmp_path}/history"


def states(h):
    return {r["id"]: r["state"] for r in h.rows().collect()}


def files(home):
    return {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, names in os.walk(f"{home}/rows") for f in names if f.endswith(".parquet")}


def test_only_changed_days_are_read_and_written(made):
    h, frame, home = made
    h.commit(durable.start_rows(frame(record("a", 1 * DAY), record("b", 2 * DAY), record("c", 3 * DAY))), 0)
    h.compact()
    before = files(home)
    h.commit(durable.finish_rows(frame(record("b", 2 * DAY, 500))), 1)
    assert states(h) == {"a": "running", "b": "error", "c": "running"}
    merged = h._folded(h._stored().filter(h._touched(["1"])[0]), h._log(["1"]))
    read = [x for x in merged._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x and "batch" not in x]
    assert len(read) == 1 and re.search(r"PartitionFilters: \[[^\]]*day#\d+[^\]]*1970-01-03", read[0]), read
    h.compact()
    after = files(home)
    same = {f for f in before if after.get(f) == before[f]}
    assert len(same) == len([f for f in before if "day=1970-01-03" not in f]) and any("day=1970-01-03" in f for f in set(after) - set(before))
    assert states(h) == {"a": "running", "b": "error", "c": "running"} and not [n for n in os.listdir(f"{home}/log") if n.startswith("batch=")]


def test_a_cut_off_compaction_does_no_harm(made, monkeypatch):
    h, frame, home = made
    h.commit(durable.start_rows(frame(record("a", DAY), record("b", DAY))), 0)
    h.commit(durable.finish_rows(frame(record("a", DAY, 200, 3), record("a", DAY, 503, 2))), 1)
    real = durable.Folder.remove
    monkeypatch.setattr(durable.Folder, "remove", lambda *a: (_ for _ in ()).throw(OSError("cut off")))
    with pytest.raises(OSError):
        h.compact()
    monkeypatch.setattr(durable.Folder, "remove", real)
    assert states(h) == {"a": "completed", "b": "running"}
    h.compact()
    h.commit(durable.finish_rows(frame(record("a", DAY, 503, 2))), 1)  # comes again, late
    assert states(h) == {"a": "completed", "b": "running"} and h.rows().count() == 2
    assert h.compact() is not None and h.compact() is None


def test_a_finish_waits_for_its_start(made):
    h, frame, _ = made
    h.commit(durable.finish_rows(frame(record("a", DAY, 200, None), record("b", DAY, None, 5, "broken"))), 0)
    h.compact()
    assert states(h) == {}
    h.commit(durable.start_rows(frame(record("a", DAY), record("b", DAY))), 1)
    assert states(h) == {"a": "completed", "b": "error"}


def test_interrupted_requests_may_still_finish(made):
    h, frame, home = made
    h.commit(durable.start_rows(frame(record("a", DAY), record("b", DAY + 50), record("c", 5 * DAY))), 0)
    h.recover(DAY + 10)
    assert states(h) == {"a": "interrupted", "b": "running", "c": "running"}
    before = files(home)
    h.recover(DAY + 10)
    assert files(home) == before
    h.commit(durable.finish_rows(frame(record("a", DAY))), 1)
    assert states(h)["a"] == "completed"


def test_retention_deletes(made):
    h, frame, home = made
    rows = [record(f"{d}{k}", d * DAY + k * 3600) for d in range(1, 8) for k in (1, 20)]
    h.commit(durable.start_rows(frame(*rows)), 0)
    h.commit(durable.finish_rows(frame(*[r for r in rows if r[0] != "21"])), 1)
    h.compact()
    before = files(home)
    assert h.retain(9 * DAY + 12 * 3600, 5) == ["1970-01-03", "1970-01-05"]  # a running one of day 2, the border in day 4
    assert sorted(states(h)) == ["21", "420", "51", "520", "61", "620", "71", "720"]
    after = files(home)
    assert not any("day=1970-01-02" in f or "day=1970-01-04" in f for f in after)
    assert all(after[f] == before[f] for f in before if f.split("day=")[1][:10] > "1970-01-05")
    assert h.retain(9 * DAY + 13 * 3600 - 1, 1) is None and h.retain(50 * DAY, 0) is None
    assert h.retain(9 * DAY + 13 * 3600, 1) is not None and sorted(states(h)) == ["21"]


def test_whole_days_go_without_being_read(spark, tmp_path):
    f = durable.Folder(spark, f"{tmp_path}/t")
    ts = F.timestamp_seconds(F.col("id") * 3600)
    f.replace_days("rows", spark.range(24 * 6).select("id", ts.alias("ts"), F.to_date(ts).alias("day")))
    with open(f"{tmp_path}/t/rows/day=1970-01-02/broken.parquet", "w") as bad:
        bad.write("no parquet")
    assert durable.expire(f, "rows", "id long, ts timestamp", "1970-01-04", F.col("ts") >= F.timestamp_seconds(F.lit(3 * 86400 + 3600 * 5))) == ["1970-01-04"]
    assert sorted(r[0] for r in f.read("rows", "id long").collect()) == list(range(24 * 3 + 5, 24 * 6))
    assert f.parts("rows", "day") == ["1970-01-04", "1970-01-05", "1970-01-06"]
