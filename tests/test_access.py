"""Keyset pages and the search index: what they give, and what they leave unread."""

import random
import re

import pytest
from pyspark.sql import functions as F

from telemill.operators import access, history, sinks
from telemill.operators.history import Search
from telemill.plans.stored import STORED

DAY = 86400.0


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        started = float(rng.choice([3600, 3601, 7200])) + DAY * rng.randrange(12)  # many ties
        word = "".join(rng.choice("abcdefgh") for _ in range(6)) + (" Nadel im Heu" if i == 77 else "")
        rows.append((f"{i:04}", started, f"m{i % 3}", "/api/chat", f"c{i % 2}", "", "completed", 200, 1.0, 0.1, 1, 1, word if i % 5 else None, f"É{word.upper()}", False, None))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in STORED.fields[:-1])
    df = spark.createDataFrame(rows, schema)
    out = str(tmp_path_factory.mktemp("stored") / "h")
    sinks.write_history(df.repartition(3, "id"), out)
    return out


def walked(inv, s, size):
    got, after = [], None
    while page := access.seek(inv, s, after, size=size).collect():
        got += [(r["started"], r["id"]) for r in page]
        after = got[-1]
    return got


@pytest.mark.parametrize("s", [Search(), Search(model="m1"), Search(q="eabc"), Search(q="no such text"), Search(since=DAY * 9)])
def test_pages_follow_each_other(spark, path, s):
    inv = spark.read.schema(STORED).parquet(path)
    whole = [(r["started"], r["id"]) for r in history.matching(inv, s).orderBy(F.desc("started"), "id").collect()]
    assert walked(inv, s, 70) == whole


def test_a_page_reads_the_days_it_needs(spark, path):
    inv = spark.read.schema(STORED).parquet(path)
    page = access.seek(inv, Search(), (DAY * 8 + 3600, "0300"), size=20)
    (scan,) = [x for x in page._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x]
    days = set(re.findall(r"1970-01-\d\d", re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", scan)[1]))
    assert days <= {"1970-01-08", "1970-01-09"} and "1970-01-09" in days
    assert access.seek(inv.limit(0), Search()).count() == 0


def test_files_without_the_needle_are_not_read(spark, path, tmp_path):
    access.build_index(spark.read.schema(STORED).parquet(path)).write.parquet(str(tmp_path / "i"))
    index = spark.read.parquet(str(tmp_path / "i"))
    inv = spark.read.schema(STORED).parquet(path)
    for q in ("nadel IM", "NADEL im heu", "Éabc", "abcdef", "c0", "x", "", "zzz", "ÉA", "é"):
        s = Search(q=q)
        part = access.indexed(spark, path, STORED, index, s)
        want = sorted(r["id"] for r in history.matching(inv, s).collect())
        assert sorted(r["id"] for r in history.matching(part, s).collect()) == want, q
        if q.lower().startswith("nadel"):
            assert want == ["0077"] and len(part.inputFiles()) <= 0.2 * len(inv.inputFiles())
    assert access.indexed(spark, path, STORED, index, Search(q="no such needle")).count() == 0
    assert access.indexed(spark, path, STORED, index.limit(0), Search(q="nadel")).count() == 600  # files that the index doesn't know


def test_day_columns_of_pages(spark, path):
    inv = spark.read.schema(STORED).parquet(path)
    assert access.seek(inv, Search()).columns == history.page(inv, Search()).columns
