"""Each operator against a brute-force version on small fixtures, with nulls, empty and long texts, ties, repeats and empty tables."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from telemill.llm import _meet, chat, langid, mixing, neighbours, packing, pii, quality, queries, secrets, setjoin, toxicity
from telemill.llm._text import span_hashes, words

DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}


def test_words_and_hashes():
    texts = ["a b", "", " x\ty \n", "é\x0bz", "ab" * 3]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    s, e, w = words(data, off)
    assert [bytes(data[a:b]).decode() for a, b in zip(s, e, strict=True)] == [x for t in texts for x in WORD.findall(t)]
    assert np.diff(w).tolist() == [len(WORD.findall(t)) for t in texts]
    h = span_hashes(data, np.array([0, 2, 0]), np.array([1, 3, 2]))
    assert len(set(h.tolist())) == 3


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DIR)
    names = sorted(df.columns)
    answer = con.execute(queries.ORACLES[name])
    at = [[x[0] for x in answer.description].index(n) for n in names]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, df.select(*names).collect()), key=key) == sorted((tuple(r[i] for i in at) for r in answer.fetchall()), key=key)


# --- 1 ------------------------------------------------------------------------


def test_language_id(spark):
    got = queries.QUERIES["op1_language_id"](spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    r = got.join(truth, "doc_id").agg(F.avg(F.when(F.col("held_out"), (F.col("lang_pred") == F.col("lang")).cast("int"))), F.min("score"), F.max("score"), F.count("*")).first()
    assert r[0] > 0.97 and 0 <= r[1] <= r[2] <= 1 and r[3] == 1000


def test_language_id_edges(spark, frame):
    docs = frame([(1, "the cat sat on the mat " * 5, "en", "a"), (2, "le chat est sur la table " * 5, "fr", "a"), (3, None, "en", "a"), (4, "", None, None), (5, "123 !!", "en", "a"), (None, "the mat", "en", "a"), (6, "le chat " * 200000, "fr", "a")])
    model = langid.train(docs)
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert got[3]["lang_pred"] == got[4]["lang_pred"] == got[5]["lang_pred"] == "und" and got[3]["score"] == 0
    assert got[None]["lang_pred"] == "en" and got[6]["lang_pred"] == "fr"
    assert langid.train(docs.limit(0)) is None
    assert langid.identify(docs, None).filter("lang_pred = 'und'").count() == 7


def test_kneser_ney_sums_to_one():
    y, off = langid.padded(pa.array(["abab abba", "ba"]), langid._letters())
    at = np.concatenate([np.arange(a + 3, b) for a, b in zip(off[:-1], off[1:], strict=True)])
    g, n = np.unique(np.concatenate([langid.grams(y, i, i + 1) for i in at]), return_counts=True)
    model = langid.build_model(["x"], np.zeros(len(g), np.int64), g, n)
    letters = [ord(c) for c in "ab "]
    for context in ("aba", "bbb", "zzz"):
        base = sum(ord(c) << s for c, s in zip(context, (48, 32, 16), strict=True))
        lp = langid.log_probs(model, np.array([base | c for c in letters], np.uint64))
        rest = langid.log_probs(model, np.array([base | ord("q")], np.uint64))  # any one character outside the alphabet
        assert np.exp(lp).sum() + np.exp(rest).sum() == pytest.approx(1, abs=1e-3)


def test_large_models_lose_nothing(spark, frame):
    """A model beyond max_grams scores as one below it, and keeps a language whose grams are all rare."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", "lang", "source").limit(150).collect()
    rare = "\u7530\u4e2d\uac00\ub098\u6c34\u6728\u706b\u571f\u91d1\u65e5"
    docs = frame([tuple(r) for r in docs] + [(-1, rare, "zz", None), (-2, "", "en", None), (-3, "\uac00\ub098\u6c34\u6728", None, None)])
    whole, parted = langid.train(docs, calibration_docs=0), langid.train(docs, max_grams=1500, calibration_docs=0)
    assert "parts" not in whole and len(parted["parts"].shared) > 2 and parted["langs"] == whole["langs"] and "zz" in whole["langs"]
    a, b = ({r["doc_id"]: r for r in langid.identify(docs, m).collect()} for m in (whole, parted))
    assert a[-1]["lang_pred"] == b[-1]["lang_pred"] == a[-3]["lang_pred"] == b[-3]["lang_pred"] == "zz"
    assert {i: r["lang_pred"] for i, r in a.items()} == {i: r["lang_pred"] for i, r in b.items()}
    assert all(b[i]["cross_entropy"] == pytest.approx(r["cross_entropy"], abs=1e-5) for i, r in a.items())
    held = langid.train(docs, max_grams=1500)
    assert held["limit"] == pytest.approx(langid.train(docs)["limit"], rel=1e-5)


def test_calibration_is_bounded_in_bytes_and_repeatable(spark, frame):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    a, b = (langid.train(docs.repartition(n), calibration_docs=100) for n in (2, 5))
    assert a["sharp"] == b["sharp"] and a["limit"] == b["limit"] and any(np.isfinite(a["limit"]))
    few = langid.train(docs, calibration_docs=100, calibration_bytes=1)  # one row: no limit can be told from it
    assert not any(np.isfinite(few["limit"])) and few["langs"] == a["langs"]


def brute_kneser_ney(texts, alphabet):
    """{gram: probability} by dictionaries and recursion, for one language."""
    grams: dict = {}
    for t in texts:
        y = "   " + " ".join(re.findall(r"[^\W\d_]+", t.lower()))
        for i in range(3, len(y)):
            grams[y[i - 3 : i + 1]] = grams.get(y[i - 3 : i + 1], 0) + 1
    levels = {4: grams}
    for k in (3, 2, 1):
        levels[k] = {}
        for g in levels[k + 1]:
            levels[k][g[1:]] = levels[k].get(g[1:], 0) + 1

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / alphabet
        counts = levels[k]
        own = {x: c for x, c in counts.items() if x[:-1] == g[:-1]}
        if not own:
            return p(g[1:])
        n1, n2 = (sum(c == n for c in counts.values()) for n in (1, 2))
        d = min(0.95, max(0.1, n1 / (n1 + 2 * n2) if n1 else 0.5))
        return max(own.get(g, 0) - d, 0) / sum(own.values()) + d * len(own) / sum(own.values()) * p(g[1:])

    return p


def test_language_id_is_the_dictionary_version(frame):
    """Entropies of a tiny corpus by nested dictionaries; a model in parts too."""
    corpus = {"x": ["abab abba", "ba ab", "caba"], "y": ["dede ed", "ab de"]}
    docs = frame([(i, t, lang, None) for i, (lang, t) in enumerate((lang, t) for lang, ts in corpus.items() for t in ts)])
    letters = {c for ts in corpus.values() for t in ts for c in t}
    probes = ["abba", "dede ab", "q ab", "ed", "ab ab de zz"]
    asked = frame([(i, t, None, None) for i, t in enumerate(probes)])
    want = {}
    for i, t in enumerate(probes):
        ce = {}
        for lang, ts in corpus.items():
            p, y = brute_kneser_ney(ts, len(letters) + 1), "   " + t
            ce[lang] = -sum(np.log(p(y[j - 3 : j + 1])) for j in range(3, len(y))) / len(t)
        want[i] = min(ce.items(), key=lambda x: (x[1], x[0]))
    for most in (10**6, 5):
        model = langid.train(docs, max_grams=most, calibration_docs=0)
        got = {r["doc_id"]: r for r in langid.identify(asked, model).collect()}
        for i, (lang, ce) in want.items():
            assert got[i]["lang_pred"] == lang and got[i]["cross_entropy"] == pytest.approx(ce, rel=1e-4)


def test_language_id_counts_the_calibration_rows_too(frame):
    """A word that only a calibration row holds is known to the model; ties go to the first language; repeated rows count."""
    docs = frame([(i, f"the cat number {'abcdefghij'[i % 10]} sat", "en", None) for i in range(400)] + [(1000 + i, "zyzzyva quux", "en", None) for i in range(3)])
    with_slice, without = langid.train(docs, calibration_docs=10**6), langid.train(docs, calibration_docs=0)
    assert all((with_slice["tables"][k]["logp"] == without["tables"][k]["logp"]).all() for k in (1, 2, 3, 4))
    same = frame([(1, "abc abc", "b", None), (2, "abc abc", "a", None), (3, "abc abc", "b", None)])
    got = langid.identify(same, langid.train(same, calibration_docs=0)).collect()
    assert {r["lang_pred"] for r in got} <= {"a", "b"} and len({(r["lang_pred"], r["score"]) for r in got}) == 1
    one = frame([(1, "abc abc", "b", None), (2, "abc abc", "a", None)])
    assert {r["lang_pred"] for r in langid.identify(one, langid.train(one, calibration_docs=0)).collect()} == {"a"}
    with pytest.raises(ValueError):
        langid.identify(docs, without, ("doc_id", "score"))


# --- 2 ------------------------------------------------------------------------


def test_mixing_edges(frame):
    docs = frame([(i, "w " * (i % 7), "en", s) for s in ("b", "a", None) for i in range(20)] + [(99, None, None, "c"), (99, None, None, "c")])
    rows = mixing.plan(docs).collect()
    total = sum(r["size"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert sum(x[0]["target"] for x in by.values()) == pytest.approx(total)
    for x in by.values():
        assert sum(r["taken"] for r in x) == pytest.approx(x[0]["target"], abs=1)
    assert mixing.plan(docs.limit(0)).count() == 0
    mixed = mixing.mix(docs)
    assert mixed.columns == [*docs.columns, "position"]
    got = {r[0]: r[1] for r in mixed.groupBy("source").agg(F.sum(mixing.word_count(F.col("text")))).collect()}
    assert got == {k: sum(r["taken"] for r in x) for k, x in by.items() if any(r["taken"] for r in x)}
    at = [r["position"] for r in mixed.collect()]
    assert at == sorted(at) and 0 <= at[0] <= at[-1] <= 1


def test_mixture_keeps_clashing_columns_and_spreads_ids(frame):
    """Columns that the plan adds keep their own values in the mixed rows; null and repeated ids are laid out by their texts."""
    rows = [(None if i % 3 else 7, " ".join(f"w{i}x{k}" for k in range(i % 9 + 1)), "en", f"s{i % 4}") for i in range(120)]
    names = ("size", "source_size", "target", "taken", "first_position", "source_rank", "position")
    docs = frame(rows).withColumns({n: F.lit(f"own {n}") for n in names})
    got = mixing.mix(docs)
    assert got.columns.count("position") == 1 and dict(got.dtypes)["position"] == "double"
    out = got.collect()
    assert all(r[n] == f"own {n}" for r in out for n in names[:-1])
    planned: dict = {}
    for r in mixing.plan(frame(rows)).collect():
        planned[r["text"]] = planned.get(r["text"], 0) + r["taken"]
    taken: dict = {}
    whole = {t for _, t, _, _ in rows}
    for r in out:
        home = next(t for t in whole if t == r["text"] or t.startswith(r["text"] + " "))
        taken[home] = taken.get(home, 0) + len(r["text"].split())
    assert taken == {t: n for t, n in planned.items() if n}


def test_curriculum_is_the_inverse_of_the_integral(spark):
    """The share of a source's tokens before its position is the integral of its weight up to there."""
    for rising, (a, b) in ((False, (1.5, 0.5)), (True, (0.5, 1.5))):
        for share in (0.0, 0.1, 0.37, 0.5, 0.9, 1.0):
            t = spark.range(1).select(mixing.curriculum_time(F.lit(share), F.lit(rising))).first()[0]
            assert a * t + (b - a) * t * t / 2 == pytest.approx(share, abs=1e-9)


def test_very_long_text_in_the_mixture(frame):
    docs = frame([(1, "a " * 300_000, None, "x"), (2, "b " * 10, None, "y"), (3, "c " * 10, None, "z")])
    assert {r["doc_id"]: r["size"] for r in mixing.plan(docs).collect()} == {1: 300_000, 2: 10, 3: 10}
    assert mixing.mix(docs).filter("doc_id = 1").count() == 1


# --- 3 ------------------------------------------------------------------------

LUHN = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(d := re.sub("[ -]", "", s)) <= 19 and LUHN(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(re.findall("[0-9]", s)) <= 15),
)


def brute_pii(text):
    return [(k, m.start(), m.end()) for k, (_, p, ok) in enumerate(PII) for m in re.finditer(p, text) if ok(m[0])]


def test_pii_base_fuzz():
    rng = random.Random(5)
    for _ in range(20000):
        t = "".join(rng.choice("+1234567890123 .-@ab()é ") for _ in range(rng.randint(0, 50)))
        assert pii.base_spans(t) == brute_pii(t), t


def test_pii_query(spark, documents):
    for r in queries.QUERIES["op3_pii"](spark, DIR).collect():
        spans = brute_pii(documents[r["doc_id"]]["text"] or "")
        text = ",".join(f"{PII[k][0]}:{a}:{b}" for k, a, b in spans)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [r[f"n_{p[0]}"] for p in PII] == [sum(s[0] == k for s in spans) for k in range(4)]


def test_pii_learns_patterns_and_redacts(frame):
    rows = [(i, f"please call me at +1 (555) 010-{i:04d} today é", "en", "a") for i in range(30)]
    rows += [(100, "please call me at 555-0199 today", "en", "a"), (101, None, None, None), (102, "", None, None), (103, "x" * 500000 + " a@b.co", None, None)]
    docs = frame(rows)
    got = {r["doc_id"]: r for r in pii.extract(docs, redact=True).collect()}
    assert got[100]["text"] == "please call me at [PHONE] today" and not got[100]["pii"][0]["base"]
    assert got[0]["text"] == "please call me at [PHONE] today é" and got[101]["text"] is None and got[101]["pii"] == []
    assert got[103]["text"].endswith(" [EMAIL]") and got[100]["kind"] == "mine"
    assert pii.extract(docs.limit(0)).count() == 0


def test_pii_uses_every_accepted_pattern(frame):
    rng = random.Random(5)
    rows = [(100 * k + i, f"Some text. Desk{k} phone line{k} +1 555 {rng.randint(1000000, 9999999)} today.", None, None) for k in range(6) for i in range(8)]
    rows += [(1000 + k, f"More text. Desk{k} phone line{k} 55{k}-12-34{k} today.", None, None) for k in range(6)]
    docs = frame(rows)
    parts = pii.learn(docs, max_patterns=2)
    whole = pii.learn(docs)
    assert len(parts.shared) > 2 and {p: k for x in parts for p, k in zip(x["pattern"].tolist(), x["kind"].tolist(), strict=True)} == whole
    a, b = ({r["doc_id"]: r["pii"] for r in pii.extract(docs, m).collect()} for m in (whole, parts))
    assert a == b and all(any(not x["base"] for x in b[1000 + k]) for k in range(6))


def test_pii_learns_what_the_graph_says(frame):
    """Pattern scores by dictionaries over the same edges."""
    rng = random.Random(12)
    leads = ["call me", "my number", "order id", "ticket no", "write to", "size of"]
    rows = []
    for i in range(400):
        lead = rng.choice(leads)
        own = f"a{rng.randrange(20)}@b.org" if lead == "write to" else f"+1 555 01{rng.randrange(40):02d}{rng.randrange(3):02d}"
        value = f"{rng.randrange(100, 999)}-1" if lead == "size of" else own if rng.random() < 0.8 else f"55-{rng.randrange(30):03d}-99"
        rows.append((i, f"so {lead} {value} {rng.choice(['today', 'now'])} é", None, None))
    docs = frame(rows)
    edges = set()
    for _, t, _, _ in rows:
        words, base = pii.Words(t), pii.base_spans(t)
        for kind, a, b in [*base, *((-1, a, b) for a, b in pii.candidates(words, base))]:
            edges |= {(p, t[a:b], kind) for p in words.patterns(a, b)}
    seeds: dict = {}
    total: dict = {}
    for p, _, kind in edges:
        total[p] = total.get(p, 0) + 1
        if kind >= 0:
            seeds[p, kind] = seeds.get((p, kind), 0) + 1
    conf = {pk: n / total[pk[0]] for pk, n in seeds.items() if n >= 5}
    strong = dict(conf)
    for _ in range(2):
        doubt: dict = {}
        for p, x, kind in edges:
            if kind < 0:
                for (q, k), c in conf.items():
                    if q == p:
                        doubt[x, k] = doubt.get((x, k), 1.0) * max(1e-6, 1 - c)
        new = {}
        for (p, k), first in strong.items():
            gain = sum(1 - doubt[x, k] for q, x, kind in edges if kind < 0 and q == p and (x, k) in doubt)
            new[p, k] = min(1.0, (seeds[p, k] + gain * first) / total[p])
        conf = new
    want = {}
    for (p, k), c in conf.items():
        if c >= 0.7:
            want[p] = min(want.get(p, (9, 9, 9)), (-round(c, 9), -seeds[p, k], k))
    assert pii.learn(docs) == {p: k for p, (_, _, k) in want.items()} and len(want) > 2


def test_pii_context_is_whole_words_and_groups(frame):
    long = "x" * 300
    a, b = pii.Words(f"id {long}1 55-12-345 {long}2 end"), pii.Words(f"id {long}9 55-12-345 {long}2 end")
    at = a.text.index("55-")
    assert a.patterns(at, at + 9) != b.patterns(at, at + 9) and len(a.patterns(at, at + 9)) == 2
    text = "ring (020) 7946 0958, or 555 123 4567. pages 12 13, 1 2 3"
    spots = pii.candidates(pii.Words(text), [])
    assert [text[i:j] for i, j in spots] == ["(020) 7946 0958", "555 123 4567"]
    rows = [(i, f"please ring us at +1 (555) 010-{i:04d} today", None, None) for i in range(30)] + [(100, "please ring us at (020) 7946 0958 today", None, None)]
    got = {r["doc_id"]: r["text"] for r in pii.extract(frame(rows), redact=True).collect()}
    assert got[100] == "please ring us at [PHONE] today"
    assert len(pii.candidates(pii.Words("1 " * 500_000), [])) == 0


# --- 4 ------------------------------------------------------------------------


def test_chat_round_trip(spark):
    rng = random.Random(3)
    bits = ["\\", "<", "</turn>\n", "<turn user\n", "\\l", "\\b", "\n", "word ", "é"]
    rows, want = [], {}
    for c in range(12):
        turns = []
        for t in range(rng.choice([1, 3, 40])):
            text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 300)))
            turns.append(("system" if t == 0 and c % 2 else rng.choice(["user", "assistant", "odd\n<role"]), text))
            rows.append((c, t, *turns[-1], "extra"))
        want[c] = turns
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window string")
    w = chat.windows(df, 200, 60)
    assert_budget(w, 200)
    for r in chat.read_back(w).collect():
        assert [(t["role"], t["text"]) for t in r["turns"]] == want[r["conv_id"]]
        assert r["loss"] == [t for role, t in want[r["conv_id"]] if role == "assistant"]
    assert {r["conv_id"] for r in w.filter("window > 0").collect()}


def assert_budget(windows, budget):
    """n_tokens is a recount of formatted, and above the budget only where one turn and the system turn are."""
    for r in windows.collect():
        turns = re.findall(r"<(turn|past) (.*)\n([^<]*)</turn>\n", r["formatted"])
        assert "".join(f"<{k} {role}\n{t}</turn>\n" for k, role, t in turns) == r["formatted"]
        assert r["n_tokens"] == sum(len(WORD.findall(t)) + chat.OVERHEAD for _, _, t in turns)
        if r["n_tokens"] > budget:
            assert sum(role != "system" for _, role, _ in turns) <= 1, r


def test_chat_windows_keep_the_budget(spark):
    """Long system turns, turns of every size and a history that must give way."""
    rng = random.Random(11)
    rows = []
    for c, sys in enumerate((0, 5, 200, 400, 507, 600, 0, 30)):
        n = 0
        if sys:
            rows.append((c, n, "system", "s " * sys))
        for n in range(1, 60):
            rows.append((c, n, rng.choice(["user", "assistant"]), "w " * rng.choice([0, 1, 3, 20, 90, 200, 508, 900] if c % 2 else [100, 120, 130])))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    w = chat.windows(df)
    assert_budget(w, 512)
    got = w.groupBy("conv_id").agg(F.max("n_tokens").alias("most"), F.bool_and(F.col("formatted").contains(" system\n")).alias("sys")).collect()
    assert all(r["most"] <= 512 for r in got if r["conv_id"] in (0, 2, 6)) and {r["conv_id"] for r in got if r["sys"]} == {1, 2, 3, 4, 5, 7}
    probe = spark.createDataFrame([(1, 0, "system", "s " * 400)] + [(1, i, "user", "w " * 200) for i in range(1, 5)], df.schema)
    assert {r["n_tokens"] for r in chat.windows(probe).collect()} == {404, 608}  # the system turn by itself, then with one turn: nothing smaller is possible
    assert w.filter("formatted like '%<past user%' or formatted like '%<past assistant%'").count() > 10


def test_chat_very_long_conversations(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f"word{i} " * (i % 9)) for i in range(3000)] + [(2, 0, "assistant", "x y " * 400_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.windows(df)).collect()}
    assert [t["text"] for t in got[1]["turns"]] == [r[3] for r in rows[:-1]] and got[1]["max_tokens"] <= 512
    assert got[2]["turns"][0]["text"] == rows[-1][3] and got[2]["n_windows"] == 1


def test_chat_nulls_and_ties(spark):
    df = spark.createDataFrame([(None, 1, "assistant", None), (None, 1, None, "a"), (2, None, "user", "x")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat.read_back(chat.windows(df)).collect()}
    assert got == {None: [("", "a"), ("assistant", "")], 2: [("user", "x")]}
    assert chat.windows(df.limit(0)).count() == 0


# --- 5 ------------------------------------------------------------------------


def test_index_finds_every_code_within_the_radius():
    """The substrings' indexes together yield each code within the radius once."""
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    codes[1500:] = codes[0] ^ (np.uint64(1) << rng.integers(0, 64, 1500).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 1500).astype(np.uint64))
    for m in (1, 2, 3, 4):
        model = {"bits": 64, "cuts": np.linspace(0, 64, m + 1).round().astype(int)}
        blocks = [neighbours.Block(model, codes, j) for j in range(m)]
        for radius in (0, 1, 3, 8, 25, 64):
            for q in codes[[0, 7, 2000]]:
                got = np.concatenate([b.within(q, radius, radius // m) for b in blocks])
                assert sorted(got.tolist()) == np.flatnonzero(np.bitwise_count(codes ^ q) <= radius).tolist()


def recall_of(got, ids, x, k=10):
    hit = asked = 0
    for q, rows in got.items():
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        hit += len({v for _, v, _ in rows} & set(ids[np.lexsort((ids, d))[:k]].tolist()))
        asked += k
    return hit / asked


def test_probing_is_selective_on_clustered_vectors(spark, monkeypatch):
    """100,000 vectors in clusters: recall of 0.9 and few rows looked at, in many buckets and blocks; one vector is a tenth of all."""
    monkeypatch.setattr(_meet, "BLOCK_ROWS", 4096)
    monkeypatch.setattr(_meet, "CHUNK_ROWS", 16)
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(1500, 32)).astype(np.float32)
    x = centres[rng.integers(0, 1500, 100_000)] + 0.08 * rng.normal(size=(100_000, 32)).astype(np.float32)
    x[90_000:] = x[7]
    ids = rng.permutation(100_000)
    df = spark.createDataFrame(pa.table({"vec_id": ids, "vector": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 32).cast(pa.list_(pa.float32()))}))
    got: dict = {}
    share = []
    for r in neighbours.search(df, df.filter("vec_id % 1000 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        if r["rank"] == 1:
            share.append(r["n_probed"] / 100_000)
    alone = {q: v for q, v in got.items() if not (x[ids == q][0] == x[7]).all()}
    assert len(got) == 100 and all(len(v) == 10 for v in got.values())
    assert recall_of(alone, ids, x.astype(float)) >= 0.9
    assert np.median(share) < 0.02, np.median(share)
    same = np.sort(ids[90_000:])
    for q in set(got) - set(alone):
        want = [v for v in np.sort(np.append(same, ids[7])).tolist() if v != q][:10]
        assert [v for _, v, _ in sorted(got[q])] == want


def test_search_of_several_lengths(spark):
    rows = [(i, [float(i), 1.0]) for i in range(5)] + [(10 + i, [float(i), 1.0, 2.0]) for i in range(4)]
    v = neighbours.valid(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got: dict = {}
    for r in neighbours.search(v, v.filter("vec_id in (0, 10)")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got[0]) == [(1, 1, 1.0), (2, 2, 2.0), (3, 3, 3.0), (4, 4, 4.0)] and sorted(got[10]) == [(1, 11, 1.0), (2, 12, 2.0), (3, 13, 3.0)]


def test_recall_and_exact_scores(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    got: dict = {}
    for r in queries.QUERIES["op5_nearest"](spark, "/root/testdata/sf0.01").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        own = sorted(got[ids[i]])
        assert [k for k, _, _ in own] == list(range(1, 11))
        assert all(abs(s - d[ids == v][0]) < 1e-12 for _, v, s in own)
    assert recall_of(got, ids, x) >= 0.9


def test_search_edges(spark):
    bad = [(3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [float("nan"), 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), *bad], "vec_id long, embedding array<float>")
    v = neighbours.valid(df)
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in neighbours.search(v, v.filter("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 0.0)]
    assert neighbours.search(v.limit(0), v.limit(0)).count() == 0


# --- 6 ------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    got = queries.QUERIES["op6_toxicity"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    r = got.filter("held_out").agg(F.count_if((F.col("toxic") == 1) & (F.col("predicted") == 1)), F.count_if(F.col("toxic") == 1), F.count_if((F.col("toxic") == 0) & (F.col("predicted") == 1)), F.count("*")).first()
    assert r[0] >= 0.75 * r[1] and r[2] <= 0.01 * r[3]


def test_toxicity_edges(spark, frame):
    docs = frame([(i, ("you rude fool here " if i % 4 == 0 else "a kind day here ") * 3 + f"n{i}", "en", "a") for i in range(200)] + [(900, None, None, None), (901, "", "en", None), (902, "calm " * 300000, "en", "a")])
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert got[0]["toxic_rejected"] and not got[1]["toxic_rejected"] and not got[902]["toxic_rejected"]
    assert 0 <= got[900]["toxicity"] < 0.5 and got[900]["toxicity"] == got[901]["toxicity"]
    assert toxicity.train(docs, labels.limit(0)) is None
    assert toxicity.score(docs, None).filter("toxic_rejected").count() == 0


def brute_score(model, text):
    """The forward pass in loops over words, widths and filters."""
    words = []
    for w in (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split():
        inner = w.strip(bytes(c for c in range(33, 127) if not chr(c).isalnum())) or w
        words.append(inner)
    ids = toxicity.buckets(pa.array([text]))[0] if words else np.zeros((0, 3), int)
    assert len(ids) == len(words)
    emb = [np.zeros(toxicity.DIM)] * 2 + [sum(model["emb"][model["map"][b]] for b in row) for row in ids] + [np.zeros(toxicity.DIM)] * 2
    z = float(model["base"])
    for i, (w, kernel) in enumerate(zip(toxicity.WIDTHS, model["kernels"], strict=True)):
        for f in range(toxicity.FILTERS):
            top = max(sum(float(emb[at + k] @ kernel[k, :, f]) for k in range(w)) for at in range(len(words) + 2))
            j = i * toxicity.FILTERS + f
            z += max(0.0, top + model["bias"][j]) * model["out"][j]
    return 1 / (1 + np.exp(-(model["a"] * z + model["b"])))


def test_toxicity_is_the_loop_version(monkeypatch):
    rng = random.Random(4)
    vocab = ["fool", "scum", "kind", "day", "Tree", "é", "walk!", "(sun)"]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 30))) for _ in range(400)]
    model = toxicity.fit(texts, np.array([int("fool" in t or "scum" in t) for t in texts]), [None] * 400)
    probe = [*texts[:40], "", None, "!!!!fool!!!!", "...", "fool", "FOOL", "a" * 50 + " fool", " ".join(texts)]
    want = [brute_score(model, t) for t in probe]
    monkeypatch.setattr(toxicity, "POSITIONS", 7)
    assert np.allclose(toxicity.scores(model, pa.array(probe)), want, atol=1e-5)
    one = toxicity.scores(model, pa.array([probe[-1]]))
    monkeypatch.setattr(toxicity, "PIECE", 50)
    assert np.allclose(toxicity.scores(model, pa.array([probe[-1]])), one, atol=1e-6)


def test_toxicity_strips_all_marks():
    ids, off = toxicity.buckets(pa.array(["fool !!!!fool!!!! ((((((fool. «fool» ?!?!", "FOOL"]))
    assert (ids[0] == ids[1]).all() and (ids[0] == ids[2]).all() and (ids[0] == ids[off[1]]).all()
    assert (ids[0] != ids[3]).any() and off.tolist() == [0, 5, 6]


def test_toxicity_clashing_and_repeated(spark, frame):
    docs = frame([(i % 50, ("you rude fool here " if i % 4 == 0 else "a kind day here ") + "word " * (i % 3), "en", "a") for i in range(100)]).withColumns({"toxicity": F.lit("mine"), "toxic_rejected": F.lit("mine")})
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(50)], "doc_id long, quality int, toxic int")
    for model in (toxicity.train(docs, labels), None):
        out = toxicity.score(docs, model)
        assert out.columns.count("toxicity") == 1 and dict(out.dtypes)["toxic_rejected"] == "boolean" and out.count() == 100
        by: dict = {}
        for r in out.collect():
            by.setdefault(r["text"], set()).add(r["toxicity"])
        assert all(len(x) == 1 for x in by.values())
    small = toxicity.train(docs.drop("lang"), labels, sample_bytes=400)
    assert small is None or 0 < small["emb"].shape[0]


def test_toxicity_learns_from_every_labelled_row(spark, frame):
    """A word of a few rows counts wherever they lie, however small the shards; counts and the calibration are over all rows."""
    rows = [(i, ("you rude fool here " if i % 4 == 0 else "a kind day here ") + f"n{i}" + (f" rare{i % 40}" * (i % 8 == 3)), "en" if i % 2 else None, "a") for i in range(1200)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(1200)], "doc_id long, quality int, toxic int")
    model = toxicity.train(frame(rows), labels, shard_docs=150)
    hashed = frame(rows).select("text", (F.pmod(F.xxhash64(F.sha2("text", 256)), F.lit(5)) == 0).alias("hold")).collect()
    use = [r["text"] for r in hashed if not r["hold"]]
    df = toxicity._document_counts(*toxicity.buckets(pa.array(use)))
    assert set(np.flatnonzero(model["map"]).tolist()) == set(np.flatnonzero(df >= 8).tolist())
    assert 8 * 150 == len(rows) and len(use) > 6 * 150
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score(frame(rows), model).collect()}
    assert all((p >= 0.5) == (i % 4 == 0) for i, p in got.items())
    held = [(r["text"], int("fool" in r["text"])) for r in hashed if r["hold"]]
    z = toxicity._logit(model, toxicity._scored(model, *toxicity.buckets(pa.array([t for t, _ in held])))).astype(float)
    y = np.array([y for _, y in held])
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    d = 1 / (1 + np.exp(-(model["a"] * z + model["b"]))) - t
    assert abs(np.mean(d * z) + 1e-3 * (model["a"] - 1)) < 1e-5 and abs(np.mean(d)) < 1e-5
    again = toxicity.train(frame(rows), labels, shard_docs=150)
    assert (again["emb"] == model["emb"]).all()


def test_toxicity_epochs_read_words_hashed_once(spark, frame, monkeypatch):
    seen, averaged = [], toxicity._averaged

    def spy(rows, model, number, most):
        if number in (0, 7):
            seen.append((rows.columns, rows.toArrow()))
        return averaged(rows, model, number, most)

    monkeypatch.setattr(toxicity, "_averaged", spy)
    rows = [(i, ("you rude fool here " if i % 4 == 0 else "a kind (day) here ") * (i % 3) + f"n{i}" * (i % 5 > 0), "en", "a") for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    assert toxicity.train(frame(rows), labels, shard_docs=100) is not None
    hashed = {tuple(map(tuple, toxicity.buckets(pa.array([t]))[0].tolist())) for _, t, _, _ in rows}
    for columns, table in seen:
        assert columns == ["words", "size", "toxic", "shard"] and table.num_rows > 200
        ids, off = toxicity._unhashed(table.column("words").combine_chunks())
        assert {tuple(map(tuple, ids[a:b].tolist())) for a, b in zip(off[:-1], off[1:], strict=True)} <= hashed


def test_toxicity_shards_of_hashed_rows():
    """Batches cut anywhere give the same shards, whose pieces end before they are too large."""
    rng = np.random.default_rng(5)
    words = [rng.integers(0, 1 << 57, n).tolist() for n in (3, 0, 5, 2, 0, 7, 1, 4)]
    table = pa.table({"words": pa.array(words, pa.list_(pa.int64())), "size": [6, 0, 10, 4, 0, 14, 2, 8], "toxic": [1, 0, 0, 1, 1, 0, 0, 1], "shard": [0, 0, 0, 1, 1, 1, 1, 2]})
    want = None
    for rows in (1, 3, 8):
        got = [(k, ids.tolist(), off.tolist(), y.tolist()) for k, ids, off, y in toxicity._shards(table.to_batches(rows), 15)]
        assert [(k, off, y) for k, _, off, y in got] == [(0, [0, 3, 3], [1, 0]), (0, [0, 5], [0]), (1, [0, 2, 2], [1, 1]), (1, [0, 7], [0]), (1, [0, 1], [0]), (2, [0, 4], [1])]
        want = want or got
        assert got == want
    assert [[r[0] | r[1] << 19 | r[2] << 38 for r in ids] for _, ids, _, _ in want] == [words[0], words[2], words[3], words[5], words[6], words[7]]


def test_toxicity_steps_and_counts_are_the_plain_ones():
    rng = np.random.default_rng(6)
    q, g, m, v = (rng.normal(size=(toxicity.BLOCK // 8 + 3, 8)).astype(np.float32) ** 2 for _ in range(4))
    pm, pv = m + 0.1 * (g - m), v + 0.01 * (g**2 - v)
    plain = q - (0.02 * (pm / (1 - 0.9**3)) / (np.sqrt(pv / (1 - 0.99**3)) + 1e-6) + 1e-3 * q).astype(np.float32)
    toxicity._step(q, g, m, v, 3)
    assert (q == plain).all() and (m == pm).all() and (v == pv).all()
    ids, off = rng.integers(1, 40, (60, 3)).astype(np.int32), np.array([0, 20, 20, 60])
    df = toxicity._document_counts(ids, off)
    assert all(df[b] == sum(b in ids[s:e] for s, e in ((0, 20), (20, 60))) for b in range(41))


# --- 7 ------------------------------------------------------------------------

SECRETS = (
    ("assign", "(" + "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)


def brute_secrets(text):
    return sorted((m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(SECRETS) for m in re.finditer(p, text) if len(m[g]) >= n)


def test_secrets_against_brute_force(spark, frame):
    rng = random.Random(9)
    bits = ["Token", "apI_key", "apikey", "paſsword", "password", " ", "=", ":", '"', "AKIA", "ABCDEFGHIJ0123456789", "0123456789abcdef", "é", "x", "passwd'  : '"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 14))), "en", "a") for i in range(600)] + [(-1, None, None, None), (-2, "z" * 400000 + " token=abcdef", None, None)]
    found = secrets.scan(frame(rows), secrets.BASE)
    got = {r["doc_id"]: [(x["start"], x["kind"], x["end"]) for x in r["found"]] for r in found.collect()}
    for i, t, _, _ in rows:
        assert got[i] == [(a, SECRETS[k][0], b) for a, k, b in brute_secrets(t or "")], t
    assert secrets.scan(frame([])).count() == 0


def test_hex_runs_at_the_edges_of_texts(frame):
    """Runs of exactly 24 at a text's start or end, whatever the next text is; halves of two texts make no run."""
    run = "0123456789abcdef01234567"
    texts = [run, "x", f"id {run}", f"{run} id", "", run, None, run[:23], run[:12], run[12:], f"é{run}", f"{run}é", run]
    got = {r["doc_id"]: r["n_hex"] for r in secrets.digest(secrets.scan(frame([(i, t, None, None) for i, t in enumerate(texts)]).coalesce(1))).collect()}
    assert got == {i: len(re.findall("[0-9a-f]{24,}", t or "")) for i, t in enumerate(texts)}


def test_added_rules_against_a_full_scan(frame):
    """Every rule through the index finds what its expression finds in every row."""
    rng = random.Random(21)
    bits = ["-----BEGIN ", "RSA ", "PRIVATE KEY-----", "ghp_", "gho_" + "a1" * 18, "xoxb-", "1234567890ab", "eyJ" + "h" * 9, ".", "eyJ" + "p" * 12, "s" * 10, "Authorization: Bearer ", "authorization:", "tok" * 6, " ", "é", "_", "-", "Token="]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 12))), None, None) for i in range(1500)]
    rules = secrets.BASE + secrets.MORE
    hits = 0
    for r in secrets.scan(frame(rows)).collect():
        text = rows[r["doc_id"]][1]
        want = sorted((m.start(), o, m.end()) for o, rule in enumerate(rules) for m in re.finditer(rule.pattern, text, re.A) if len(m[rule.group]) >= rule.least)
        assert [(x["start"], x["kind"], x["end"]) for x in r["found"]] == [(a, rules[o].kind, b) for a, o, b in want]
        hits += len(want)
    assert hits > 300


def test_rules_take_linear_time():
    import time

    for text in ("eyJ" * 1_700_000, "eyJaaaaaaaa." * 400_000, "token " * 800_000, "password" + " " * 5_000_000, "a" * 5_000_000, "ghp_" * 1_200_000, "xoxb-" * 1_000_000, "authorization: bearer " * 230_000):
        for rule in secrets.BASE + secrets.MORE:
            began = time.time()
            secrets.spans_of(rule, re.compile(rule.pattern, re.A), text)
            assert time.time() - began < 5, (rule.kind, text[:20])


def test_secrets_repeated_and_clashing(frame):
    got = secrets.scan(frame([(1, "token=abcdef", None, None)] * 3), keep=("doc_id", "score", "kind")).collect()
    assert len(got) == 3 and all(len(r["found"]) == 1 and r["kind"] == "mine" for r in got)
    with pytest.raises(ValueError):
        secrets.scan(frame([]).withColumn("found", F.lit(1)), keep=("doc_id", "found"))


def test_trigram_queries_are_necessary():
    assert secrets.trigram_query(r"[0-9a-f]+") == ("all",)
    for rule in secrets.BASE[:2] + secrets.MORE:
        assert secrets.trigram_query(rule.pattern) != ("all",), rule.kind
    assert secrets.trigram_query(r"abc?d") == ("all",) or "abd" in secrets._tris(secrets.trigram_query(r"abc?d"))


def test_secret_query(spark, documents):
    for r in queries.QUERIES["op7_secret_scan"](spark, DIR).collect():
        text = ",".join(f"{SECRETS[k][0]}:{a}:{b}" for a, k, b in brute_secrets(documents[r["doc_id"]]["text"] or ""))
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()


# --- 8 ------------------------------------------------------------------------


def shingles(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def planted(rng):
    """Families of edited copies of many sizes, some chained, beside unrelated texts that share a passage."""
    vocab = [f"w{i}" for i in range(4000)]
    passage = [rng.choice(vocab) for _ in range(60)]
    texts, n = {}, 0
    for size in (1, 3, 5, 6, 8, 9, 10, 12, 15, 20, 28, 40, 60, 90, 140, 260, 500, 900):
        base = [rng.choice(vocab) for _ in range(size)]
        for k in range(7):
            texts[n] = " ".join(base)
            n += 1
            base = list(base)
            for _ in range(max(1, size // rng.choice([25, 60, 120]))):
                at = rng.randrange(len(base))
                if k % 3 == 0:
                    base.insert(at, rng.choice(vocab))
                else:
                    base[at] = rng.choice(vocab)
    for _ in range(60):
        own = [rng.choice(vocab) for _ in range(rng.randint(5, 120))]
        texts[n] = " ".join(own[:3] + passage + own[3:])
        n += 1
    return texts | {n: "", n + 1: None, n + 2: " \n", n + 3: texts[9].upper(), n + 4: texts[50]}


@pytest.mark.parametrize("seed", [1, 2])
def test_join_loses_no_link(frame, seed):
    texts = planted(random.Random(seed))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in setjoin.cluster(frame([(i, t, None, None) for i, t in texts.items()])).collect()}
    assert got == brute_components(texts)


def test_signatures_meet_for_every_pair_within_the_bound():
    """Pairs at the very edge of the threshold share a signature, in every size."""
    rng = np.random.default_rng(4)
    for size in [*range(4, 60), 100, 333, 1000]:
        for _ in range(6):
            common = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            for extra in range(size // 4 + 1):
                one = rng.integers(0, extra + 1)
                a = np.unique(np.concatenate([common, rng.integers(0, 1 << 63, one, dtype=np.uint64)]))
                b = np.unique(np.concatenate([common, rng.integers(0, 1 << 63, extra - one, dtype=np.uint64)]))
                if 100 * size < 80 * (size + extra) or size > 60 and extra < size // 4:
                    continue
                sig, text = setjoin.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
                assert extra == 0 or np.intersect1d(sig[text == 0], sig[text == 1]).size, (size, extra)


def test_join_edges(frame):
    assert setjoin.cluster(frame([])).count() == 0
    docs = frame([(5, "a b c d e f", None, None), (None, "a b c d e f", None, None), (3, "A B C D E F", None, None), (3, "A B C D E F", None, None), (9, "x", None, None)])
    got = sorted(((r["doc_id"], r["component_id"]) for r in setjoin.cluster(docs).collect()), key=str)
    assert got == sorted([(5, 3), (None, 3), (3, 3), (3, 3), (9, 9)], key=str)


def thue_morse(n, swap=False):
    word, other = "a", "b"
    while len(word) < n:
        word, other = word + other, other + word
    return other if swap else word


def test_join_compares_bytes(frame):
    """Words on which polynomial hashes meet are different words; shared hashes alone link nothing."""
    for n in (1024, 4096, 16384):
        x, y = thue_morse(n), thue_morse(n, True)
        got = {r["doc_id"]: r["component_id"] for r in setjoin.cluster(frame([(1, f"p q {x} r t", None, None), (2, f"p q {y} r t", None, None), (3, f"P  q {x.upper()} r t", None, None)])).collect()}
        assert got == {1: 1, 2: 2, 3: 1}
    one, two = setjoin.Sets([b"a b c d e f"]), setjoin.Sets([b"a b c d e g"])
    assert one.common(0, one, 0) == 2 and one.common(0, two, 0) == 1
    two.token = one.token.copy()  # as if all hashes met
    assert one.common(0, two, 0) <= 1


def test_join_of_unrelated_texts_with_a_passage(frame, monkeypatch):
    """200 texts that are mostly one passage and yet unrelated, some near copies among them; in blocks of 32 classes."""
    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(60))
    own = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(25))
    texts = {i: f"{own()} {passage} {own()}" for i in range(200)}
    texts |= {200 + i: texts[i] + " more" for i in range(0, 40, 4)}
    texts |= {300 + i: texts[200 + i].replace("p30", "q30", 1) for i in range(0, 40, 8)}
    docs = frame([(i, t, None, None) for i, t in texts.items()])
    want = brute_components(texts)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in setjoin.cluster(docs).collect()} == want
    monkeypatch.setattr(setjoin, "BLOCK", 32)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in setjoin.cluster(docs).collect()} == want


def test_blocks_meet_every_pair():
    """The scan of a signature's classes in blocks finds all pairs of different components, however rows fall into batches."""
    rng = np.random.default_rng(6)
    n = 60
    label, cid, block = rng.integers(0, 5, n), np.arange(100, 100 + n), rng.integers(0, 3, n)
    sk = pa.array([[0] * 16] * n, pa.list_(pa.int64()))
    rows = []
    for part in range(3):
        own = block == part
        order = np.concatenate([np.flatnonzero(own), np.flatnonzero(~own)])
        t = pa.table({"sig": np.full(n, 7), "part": np.full(n, part, np.int32), "own": own, "n": np.full(n, 50), "label": label, "cid": cid}).append_column("sketch", sk)
        rows.append(t.take(order))
    t = pa.concat_tables(rows)
    want = {(int(cid[i]), int(cid[j])) for i in range(n) for j in range(i + 1, n) if label[i] != label[j]}
    for size in (1, 7, 1000):
        got = [x for b in setjoin._across(80)(iter(t.combine_chunks().to_batches(size))) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        assert set(got) == want and len(got) == len(want)


def test_shared_signatures_across_batches():
    rng = np.random.default_rng(2)
    sig, cid = np.sort(rng.integers(0, 12, 80)), np.zeros(80, np.int64)
    for s in range(12):
        cid[sig == s] = np.sort(rng.integers(0, (1, 2, 4)[s % 3], (sig == s).sum()))
    t = pa.table({"sig": sig, "pivot": pa.nulls(80, pa.int64()), "cid": cid})
    want = {(s, c) for s in set(sig.tolist()) for own in [set(cid[sig == s].tolist())] if len(own) > 1 for c in own}
    for size in (1, 3, 1000):
        got = [tuple(r.values()) for b in setjoin._shared(iter(t.to_batches(size))) for r in b.to_pylist()]
        assert set(got) == want and 0 < len(want) < len(set(zip(sig.tolist(), cid.tolist(), strict=True)))


def test_long_sketches(frame):
    """A sketch folds into that of half as many cells, and pairs on both sides of a power of two are compared, linked or not."""
    rng = np.random.default_rng(5)
    tok = np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64))
    big = np.array(setjoin.long_sketch(tok), np.int64).view(np.uint64)
    off = np.array([0, len(tok)])
    assert len(big) * 64 == 4096 and setjoin.long_sketch(tok[:1024]) is None
    assert ((big[:32] ^ big[32:]) == setjoin.sketches(tok, off, 2048)[0]).all()
    assert (big.reshape(4, 16)[0] ^ big.reshape(4, 16)[1] ^ big.reshape(4, 16)[2] ^ big.reshape(4, 16)[3] == setjoin.sketches(tok, off)[0]).all()
    words = [f"w{i}" for i in range(2040)]
    texts = {1: words, 2: words + [f"x{i}" for i in range(60)], 3: words[:1100] + [f"y{i}" for i in range(1000)], 4: words[:1030], 5: words[:1010], 6: words[500:1530]}
    got = setjoin.cluster(frame([(i, " ".join(t), None, None) for i, t in texts.items()])).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components({i: " ".join(t) for i, t in texts.items()})
    assert {r["doc_id"]: r["component_id"] for r in got}[2] == 1


def test_join_of_very_long_texts(frame):
    """Texts beyond the size of a piece, and sets in high bands."""
    base = [f"w{i}" for i in range(200_000)]
    edited = [w if i % 60 else "x" + w for i, w in enumerate(base)]
    far = [w if i % 10 else "x" + w for i, w in enumerate(base)]
    long = "z" * 9_000_000
    docs = frame([(1, " ".join(base), None, None), (2, "\t".join(edited).upper(), None, None), (3, " ".join(far), None, None), (4, f"{long} a  b", None, None), (5, f"{long}\na b", None, None)])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in setjoin.cluster(docs).collect()}
    assert got[1] == (199_996, 1) and got[2][1] == 1 and got[3][1] == 3 and got[4] == (1, 4) and got[5] == (1, 4)
    assert setjoin.allocate(40, 80)[0] > 1 << 38


def test_names_that_meet_are_drawn_anew(frame, monkeypatch):
    real = setjoin.class_id
    monkeypatch.setattr(setjoin, "class_id", lambda form, salt: (5, len(form)) if salt == 0 else real(form, salt))
    docs = frame([(1, "a b c d e f", None, None), (2, "g h i j k l m", None, None), (3, "a b  c d e f", None, None)])
    assert {r["doc_id"]: r["component_id"] for r in setjoin.cluster(docs).collect()} == {1: 1, 2: 2, 3: 1}


def test_join_keeps_clashing_columns(frame):
    docs = frame([(1, "a b c d e f", "en", "s"), (2, "a b c d e f", None, "s")])
    for c in ("cid", "sketch", "n", "check", "label"):
        docs = docs.withColumn(c, F.lit("own"))
    got = setjoin.cluster(docs, keep=("doc_id", "cid", "sketch", "n", "check", "label")).collect()
    assert all(r["component_id"] == 1 and r["cid"] == r["sketch"] == r["n"] == "own" for r in got)
    with pytest.raises(ValueError):
        setjoin.cluster(docs.withColumn("n_shingles", F.lit(1)), keep=("doc_id", "n_shingles"))


# --- 9 ------------------------------------------------------------------------


def test_tokens_equal_the_tokenizer(spark, documents):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    tok.encode_special_tokens = True
    rng = random.Random(1)
    bits = ["'", "s", "t", "re", "ve", "m", "ll", "d", " ", "  ", "\n", "a", "é", "1", "²", "!", "-", "\t", "　", "你", "🙂", "'s", "'S", " ", "<|endoftext|>"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(4000)] + [r["text"] for r in list(documents.values())[:60]]
    ids, off = packing.Encoder(open(packing.default_tokenizer()).read())(pa.array(texts))
    for i, e in enumerate(tok.encode_batch(texts, add_special_tokens=False)):
        assert ids[off[i] : off[i + 1]].tolist() == e.ids, texts[i]


def test_added_tokens_are_one_id(frame):
    """Against the tokenizer in its default state, in which added tokens in texts are themselves."""
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    tok = Tokenizer.from_file(path)
    end = "<|endoftext|>"
    rng = random.Random(2)
    bits = [end, end, end[:5], end[5:], "<", "|>", "'", "s", " ", "  ", "\n", "a", "é", "1", "!", "你", "🙂"]
    texts = [f"a{end}b", end, end * 2, f"  {end}  ", end[:6], end[6:], "", f"'{end}s"] + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert want[0] == [64, 50256, 65]
    ids, off = packing.Encoder(open(path).read(), encode_special_tokens=False)(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == want
    rows = packing.pack_documents(frame([(i, t, None, None) for i, t in enumerate(texts)]), path, end_id=1).collect()
    assert {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in rows} == {i: [*w, 1] for i, w in enumerate(want)}


def test_packing(spark, frame, documents):
    docs = frame([(i, r["text"], None, None) for i, r in documents.items()] + [(-1, None, None, None), (-2, "", None, None), (-2, "", None, None)])
    rows = packing.pack_documents(docs, packing.default_tokenizer()).collect()
    by_doc: dict = {}
    by_seq: dict = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
        assert len(r["ids"]) == 4 * r["length"] > 0
    for i, x in by_doc.items():
        if i != -2:
            x.sort(key=lambda r: r["start"])
            assert [r["start"] for r in x] == np.concatenate([[0], np.cumsum([r["length"] for r in x])[:-1]]).astype(int).tolist()
            assert sum(r["length"] for r in x) == x[0]["doc_tokens"]
    full = 0
    for x in by_seq.values():
        x.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in x] == np.concatenate([[0], np.cumsum([r["length"] for r in x])[:-1]]).astype(int).tolist()
        size = sum(r["length"] for r in x)
        assert size <= 2048 and len(x) <= 256
        full += size
    assert full >= 0.97 * 2048 * len(by_seq)
    d = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in packing.digest(packing.pack_documents(docs, packing.default_tokenizer())).collect()}
    assert all(d[r["doc_id"], r["start"]] == zlib.crc32(r["ids"]) for r in rows)
    assert packing.pack_documents(docs.limit(0), packing.default_tokenizer()).count() == 0


def test_pretokens_are_told_apart_by_bytes(frame, monkeypatch):
    """Words on which prefix-sum hashes meet, and any words once all hashes are made to meet, keep their own ids."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    texts = [thue_morse(n, swap) for n in (64, 1024, 2048, 4096) for swap in (False, True)] + ["ab " * 50, "one two three two one"]
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        ids, off = packing.Encoder(open(packing.default_tokenizer()).read())(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == want
        monkeypatch.setattr(packing, "span_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))


@pytest.mark.parametrize(("limits", "binding"), [((200, 100, 10**6), 0), ((10**4, 3, 10**6), 1), ((4096, 100, 90), 2)])
def test_each_limit_binds(spark, limits, binding):
    """Formatted conversations, loss on the assistant's text alone; each limit in turn is what closes sequences."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    w = chat.windows(spark.read.parquet(f"{DIR}/conversations.parquet"), 128, 0).select("conv_id", "window", "formatted", "loss_spans").coalesce(1)
    w = spark.createDataFrame(w.collect(), w.schema)
    rows = packing.pack_documents(w, packing.default_tokenizer(), ("conv_id", "window"), *limits, text="formatted", loss="loss_spans").collect()
    by: dict = {}
    whole: dict = {}
    for r in rows:
        x = by.setdefault(r["sequence_id"], [0, 0, 0])
        x[0], x[1], x[2] = x[0] + r["length"], x[1] + 1, x[2] + r["n_loss"]
        assert r["n_loss"] == sum(r["loss_mask"]) and len(r["loss_mask"]) == r["length"]
        whole.setdefault((r["conv_id"], r["window"]), []).append((r["start"], r["ids"], r["loss_mask"]))
    assert all(a <= b for x in by.values() for a, b in zip(x, limits, strict=True))
    assert max(x[binding] for x in by.values()) > 0.9 * limits[binding] and len(by) > 3
    assert sum(x[binding] for x in by.values()) > 0.75 * limits[binding] * (len(by) - 1)
    for r in w.collect():
        pieces = sorted(whole[r["conv_id"], r["window"]])
        e = tok.encode(r["formatted"], add_special_tokens=False)
        assert np.frombuffer(b"".join(p[1] for p in pieces), "<u4").tolist() == [*e.ids, 1]
        starts = [m[0] for m in e.offsets]
        if r["formatted"].isascii():  # offsets are in code points; a token may begin within a character
            mask = [any(s["start"] <= a < s["end"] for s in r["loss_spans"]) for a in starts] + [False]
            assert [bool(x) for p in pieces for x in p[2]] == mask


def test_sequences_follow_an_order(frame, documents, monkeypatch):
    """Sequence numbers rise with the least place of their pieces, over windows and partitions."""
    monkeypatch.setattr(packing, "WINDOW_ITEMS", 50)
    rng = random.Random(3)
    places = list(range(len(documents)))
    rng.shuffle(places)
    rows = [(k, r["text"], None, None) for k, r in zip(places, documents.values(), strict=True)]
    docs = frame(rows).withColumn("n", F.col("doc_id") % 7).repartition(5)
    got = packing.pack_documents(docs, packing.default_tokenizer(), keep=("doc_id", "n"), order=("n", "doc_id")).collect()
    least: dict = {}
    for r in got:
        least[r["sequence_id"]] = min((r["n"], r["doc_id"], r["start"]), least.get(r["sequence_id"], (9,)))
    found = [x for _, x in sorted(least.items())]
    assert len(found) > 60 and found == sorted(found)
    assert sum(r["length"] for r in got) == sum(r["doc_tokens"] for r in got if r["start"] == 0)


def loop_pack(items, limits):
    """The dot-product choice written as plain loops; items are (tokens, segments, loss)."""
    share = [[x / m for x, m in zip(item, limits, strict=True)] for item in items]
    waiting = sorted(range(len(items)), key=lambda i: (-sum(share[i]), i))
    place, n = {}, 0
    while waiting:
        room = list(limits)
        pick = waiting[0]
        while pick is not None:
            place[pick] = n
            waiting.remove(pick)
            room = [a - b for a, b in zip(room, items[pick], strict=True)]
            pick, most = None, -1.0
            for i in waiting:
                if all(a <= b for a, b in zip(items[i], room, strict=True)):
                    value = sum(s * a / m for s, a, m in zip(share[i], room, limits, strict=True))
                    if value > most + 1e-12:
                        pick, most = i, value
        n += 1
    return [place[i] for i in range(len(items))], n


def test_bins_are_those_of_the_loops():
    for seed in range(20):
        rng = random.Random(seed)
        limits = rng.choice([(64, 4, 32), (256, 128, 64), (128, 8, 16)])  # shares without rounding
        items = [(t, 1, rng.randint(0, min(t, limits[2]))) for t in (rng.randint(1, limits[0]) for _ in range(60))]
        bins, n = packing.pack(*(np.array(x) for x in zip(*items, strict=True)), limits)
        assert (bins.tolist(), n) == loop_pack(items, limits)


def test_packing_edges(frame):
    docs = frame([(1, "word " * 400_000, None, None), (2, None, None, None), (3, "q" * 300_000, None, None), (4, "a", None, None), (4, "a", None, None)])
    rows = packing.pack_documents(docs, packing.default_tokenizer(), ("doc_id", "score", "kind")).collect()
    total: dict = {}
    for r in rows:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
        assert r["score"] == 9.0 and r["kind"] == "mine"
    assert total[1] > 400_000 and total[2] == 1 and total[4] == 4
    assert all(r["n_loss"] == r["length"] - 1 for r in rows)
    with pytest.raises(ValueError):
        packing.pack_documents(docs.withColumn("ids", F.lit(1)), packing.default_tokenizer(), ("doc_id", "ids"))


def test_bins_keep_all_three_limits():
    rng = np.random.default_rng(2)
    t = rng.integers(1, 900, 500)
    loss = rng.integers(0, t + 1)
    bins, n = packing.pack(t, np.ones(500, np.int64), loss, (2048, 5, 700 + 200))
    for b in range(n):
        own = bins == b
        assert t[own].sum() <= 2048 and own.sum() <= 5 and loss[own].sum() <= 900
    assert set(bins.tolist()) == set(range(n))


# --- 10 -----------------------------------------------------------------------


def brute_quality(text):
    w = WORD.findall(text or "")
    grams: dict = {}
    for i in range(len(w) - 7):
        grams.setdefault(tuple(w[i : i + 8]), []).append(i)
    marked = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(marked)


def test_quality_base(frame):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice(["a ", "b ", "c\n", "é ", "#| ", "\x0b", "the same line of eight words here now\n"]) for _ in range(rng.randint(0, 80))), None, rng.choice(["x", None])) for i in range(150)]
    rows += [(900, None, None, "x"), (901, "", None, None), (902, "long " * 60000, None, "x")]
    for r in quality.base_stats(frame(rows)).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_quality(r["text"]), r["text"]


def test_common_lines_go(frame):
    own = lambda i: " ".join(f"own{i}x{k}" for k in range(30))
    rows = [(i, f"Accept all 99 cookies please\n{own(i)}", None, "h") for i in range(25)]
    rows += [(100 + i, f"Accept all 99 cookies please\n{own(100 + i)}", None, "other") for i in range(5)]
    rows += [(200, "accept  all 12 cookies please\n" * 5 + "one two", None, "h")]
    got = {r["doc_id"]: r for r in quality.assess(frame(rows)).collect()}
    assert got[0]["kept"] and got[0]["clean_text"] == own(0) and got[0]["n_removed_lines"] == 1
    assert got[100]["n_removed_lines"] == 0 and got[100]["clean_text"].startswith("Accept")
    assert not got[200]["kept"] and got[200]["depleted"]
    assert quality.assess(frame([])).count() == 0


def test_common_lines_are_a_share_of_large_hosts(frame):
    """A line in more than 20 documents goes from a small host, and stays in one where that is a small share; just the limit stays."""
    rng = random.Random(2)
    own = lambda i: " ".join("".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(30))
    rows = [(i, f"a short common line\n{own(i)}" if i < 30 else own(i), None, "large") for i in range(300)]
    rows += [(1000 + i, f"a short common line\n{own(1000 + i)}", None, "small") for i in range(25)]
    rows += [(2000 + i, f"a line at the limit\n{own(2000 + i)}", None, "edge") for i in range(20)]
    got = {r["doc_id"]: r["n_removed_lines"] for r in quality.assess(frame(rows), max_share=0.2).collect()}
    assert got[0] == 0 and got[1000] == 1 and got[2000] == 0
    assert {r["doc_id"]: r["n_removed_lines"] for r in quality.assess(frame(rows)).collect()}[0] == 1


def test_quality_repeated_rows_and_null_hosts(frame):
    line = "one line that all of them hold"
    rows = [(1, f"{line}\n" + " ".join(f"w{k}" for k in range(30)), None, None)] * 22 + [(None, "x", None, "h")]
    got = quality.assess(frame(rows).withColumn("kept", F.lit("mine"))).collect()
    assert len(got) == 23 and all(r["n_removed_lines"] == 2 for r in got if r["doc_id"] == 1)  # repeated documents are documents
    assert not any(r["kept"] for r in got)


def test_quality_is_linear_in_removed_lines(frame):
    """Documents of thousands of lines that all of them hold; the rest of each text stays in order."""
    import time

    took = []
    for n in (2000, 8000, 16000):
        common = [f"common line number {'x' * (k % 50)} {''.join(chr(97 + int(c)) for c in str(k))}" for k in range(n)]
        own = lambda i: [f"own {''.join(chr(97 + int(c)) for c in str(i))} {''.join(chr(97 + int(c)) for c in str(k))}" for k in range(3 * n)]
        rows = []
        for i in range(24):
            mine = own(1000 + i)
            rows.append((i, "\n".join(x for k in range(n) for x in (mine[3 * k], common[k], "", mine[3 * k + 1], mine[3 * k + 2])), None, "h"))
        docs = frame(rows).repartition(2).cache()
        docs.count()
        began = time.time()
        got = {r["doc_id"]: r for r in quality.assess(docs).collect()}
        took.append(time.time() - began)
        for i in range(24):
            mine = own(1000 + i)
            assert got[i]["n_removed_lines"] == n and got[i]["kept"]
            assert got[i]["clean_text"] == "\n".join(x for k in range(n) for x in (mine[3 * k], "", mine[3 * k + 1], mine[3 * k + 2]))
        docs.unpersist()
    assert took[2] <= 2.5 * took[1]
