"""Periodic runs against a brute-force version."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from telemill.llm import queries, runs

DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(ws, least=12):
    """(start, length, period) of all runs, by comparing words at every distance."""
    found: dict = {}
    for p in range(1, len(ws) // 2 + 1):
        i = 0
        while i + p < len(ws):
            s = i
            while i + p < len(ws) and ws[i] == ws[i + p]:
                i += 1
            if i > s and i + p - s >= max(least, 2 * p):
                found.setdefault((s, i + p), p)
            i += 1
    return sorted(((s, e - s, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


def brute_collapse(ws, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(ws) if i not in gone)


def flat_of(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in raw], dtype=np.int64)])


def results(texts, least=12):
    data, off = flat_of(texts)
    found, spans = runs.runs_of_words(data, off, least)
    listed = [[(r["start"], r["length"], r["period"]) for r in x] for x in runs._listed(found, spans[2]).to_pylist()]
    return listed, runs.collapse(data, off, spans, found).to_pylist()


def made_texts(rng, n):
    for _ in range(n):
        size, letters = rng.randrange(0, 90), "abcdefgh"[: rng.choice([1, 2, 2, 3, 5])]
        ws = [rng.choice(letters) for _ in range(size)]
        if size > 10 and rng.random() < 0.5:
            a = rng.randrange(size)
            p = 1 + rng.randrange((size - a) // 2 + 1)
            ws = [ws[i] if i < a else ws[a + (i - a) % p] for i in range(size)]
        yield "".join(w + rng.choice([" ", "\n", "  ", "\t", " é "]) for w in ws)


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_are_those_of_brute_force(least):
    texts = ["", " \n", "a", "a " * 40, *made_texts(random.Random(least), 400)]
    found, collapsed = results(texts, least)
    for t, f, c in zip(texts, found, collapsed, strict=True):
        ws = WORD.findall(t)
        assert f == brute_runs(ws, least) and c == brute_collapse(ws, f)


def words_of(rule, start, n):
    t = start
    while len(t) < n:
        t = "".join(rule[c] for c in t)
    return t[:n]


def test_words_that_deceive_hashes_modulo_powers_of_two():
    """Stretches of Thue and Morse agree in such hashes though their words differ; the second attempt tells them apart."""
    tm = words_of({"a": "ab", "b": "ba"}, "a", 4096)
    turned = tm.translate(str.maketrans("ab", "ba"))
    texts = [" ".join(tm + turned + tm), " ".join(tm + tm + turned), " ".join(words_of({"a": "ab", "b": "a"}, "a", 1500))]
    found, _ = results(texts)
    codes = np.array([ord(c) for c in tm + turned], np.uint64)
    assert runs.Prefixes(codes, 0).same(np.array([0]), np.array([4096]), np.array([4096]))[0]
    assert not runs.Prefixes(codes, 1).same(np.array([0]), np.array([4096]), np.array([4096]))[0]
    for t, f in zip(texts, found, strict=True):
        assert f == brute_runs(t.split())


def test_words_with_equal_codes_are_told_apart(monkeypatch):
    monkeypatch.setattr(runs, "span_hashes", lambda data, starts, ends: (data[starts] % 3).astype(np.uint64))
    texts = list(made_texts(random.Random(5), 100))
    found, _ = results(texts)
    assert found == [brute_runs(WORD.findall(t)) for t in texts]


def test_small_steps_give_the_same(monkeypatch):
    texts = list(made_texts(random.Random(6), 150))
    whole = results(texts)
    monkeypatch.setattr(runs, "PAIRS", 40)
    assert results(texts) == whole


def test_very_long_texts():
    rng = random.Random(2)
    ws = [str(rng.randrange(2000)) for _ in range(300_000)]
    ws[1000:250_000] = [ws[1000 + i % 70_001] for i in range(249_000)]
    found, collapsed = results([" ".join(ws), "a " * 300_000])
    assert (1000, 249_000, 70_001) in found[0] and found[1] == [(0, 300_000, 1)]
    assert collapsed[1] == "a" and len(collapsed[0].split()) == 300_000 - 249_000 + 70_001


def brute_row(doc_id, text):
    ws = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(ws)
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]
    found = brute_runs(ws)
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    milli = None if best[1] is None else 1000 * best[1] // best[2]
    return (doc_id, len(found), *best, milli, sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), sha(brute_collapse(ws, found)))


def test_query(spark):
    rows = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()
    short = {r[0]: r[1] for r in rows if r[1] is None or len(r[1]) < 8000}
    got = {r[0]: tuple(r) for r in queries.QUERIES["op13_periodic_runs"](spark, DIR).collect()}
    assert len(got) == len(rows) and len(short) > 150
    assert all(got[i] == brute_row(i, t) for i, t in short.items())
    assert sum(r[1] > 0 for r in got.values()) > 20


def test_query_over_odd_tables(spark, frame, tmp_path):
    rows = [(i, t, None, None) for i, t in enumerate(["", None, " \n", "a " * 50, "x y z " * 20, "é ü " * 9] * 12)]
    docs = frame([*rows, (None, "a " * 30, None, None), (None, "a " * 30, None, None), (3, "a " * 50, None, None)])
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    key = lambda r: tuple((x is not None, x) for x in r)
    got = sorted(map(tuple, queries.QUERIES["op13_periodic_runs"](spark, f"{tmp_path}/a").collect()), key=key)
    assert got == sorted((brute_row(r["doc_id"], r["text"]) for r in docs.collect()), key=key)
    docs.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert queries.QUERIES["op13_periodic_runs"](spark, f"{tmp_path}/b").count() == 0


def test_columns_are_kept_or_refused(frame):
    docs = frame([(1, "a b " * 10, "en", "s"), (1, "a b " * 10, "en", "s")])
    got = runs.find_runs(docs, keep=("doc_id", "kind", "score")).collect()
    assert [(r["doc_id"], r["kind"], r["score"], r["n_words"], r["collapsed"], [tuple(x) for x in r["runs"]]) for r in got] == [(1, "mine", 9.0, 20, "a b", [(0, 20, 2)])] * 2
    with pytest.raises(ValueError):
        runs.find_runs(docs.withColumn("runs", F.lit(1)), keep=("runs",))
    with pytest.raises(ValueError):
        runs.find_runs(docs, least=1)
