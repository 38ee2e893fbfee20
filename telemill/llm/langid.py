"""Language identification with interpolated Kneser-Ney character models.

Counts of character 4-grams are taken over every training document; all lower
orders are continuation counts derived from them. For each order one sorted
array of 64-bit hashes serves all languages, with a row of log probabilities (a
column a language) beside each hash, so that one binary search scores a
position for every language. The language of lowest length-normalised
cross-entropy wins; per-language limits on that entropy, calibrated on training
documents that a first model's counts leave out, give `accepted`. The model itself
has the counts of all training rows.

Characters are lower-cased letters; any run of other characters is one space.
Null or letterless texts give ("und", 0.0). Ties go to the language that sorts
first. Repeated rows count as often as they stand. Without training rows every
text is "und"; an empty table gives no rows. Columns to keep must not have the names
of added ones. A text is scored whole, in about 40 bytes of memory a byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm._text import SLICE_BYTES, U64, Parts, Tables, codepoints, flat, no_clash, slices, tidied

ORDER = 4
SPACE = 32
_ODD = U64(0x9E3779B97F4A7C15)
#: Positions scored at once.
WINDOW = 1 << 18


def _letters() -> np.ndarray:
    """Normal form of each 16-bit code: a lower-case letter, or a space."""
    t = np.full(1 << 16, SPACE, np.uint32)
    for c in range(1 << 16):
        if chr(c).isalpha():
            low = chr(c).lower()
            t[c] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else c
    return t


def _normal(cps: np.ndarray, table: np.ndarray) -> np.ndarray:
    out = table[np.minimum(cps, 0xFFFF)]
    big = np.flatnonzero(cps > 0xFFFF)
    for i in big:  # rare planes fold into the private use area
        c = int(cps[i])
        out[i] = 0xE000 + (c & 0x0FFF) if chr(c).isalpha() else SPACE
    return out


def padded(column, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised characters with ORDER-1 spaces before each text, and text offsets."""
    cps, off = codepoints(*flat(column))
    x = _normal(cps, table)
    before = np.empty_like(x)
    if len(x):
        before[0], before[1:] = SPACE, x[:-1]
        before[off[:-1][np.diff(off) > 0]] = SPACE
    keep = (x != SPACE) | (before != SPACE)
    off = np.concatenate([[0], np.cumsum(keep)])[off]
    x, sizes = x[keep], np.diff(off)
    out = np.full(len(x) + (ORDER - 1) * len(sizes), SPACE, np.uint64)
    new = np.arange(len(x)) + (ORDER - 1) * (np.repeat(np.arange(len(sizes)), sizes) + 1)
    out[new] = x
    return out, off + (ORDER - 1) * np.arange(len(off))


def grams(y: np.ndarray, a: int, b: int) -> np.ndarray:
    """The 4-gram that ends at each position of [a, b); a is at least ORDER-1."""
    return y[a - 3 : b - 3] << U64(48) | y[a - 2 : b - 2] << U64(32) | y[a - 1 : b - 1] << U64(16) | y[a:b]


def _counter(table):
    def count(batches):
        seen: dict[str, list] = {}
        held = 0

        def out():
            for lang, parts in seen.items():
                k, i = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                c = np.bincount(i, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k.view(np.int64)), pa.array(c)], ["lang", "gram", "n"])
            seen.clear()

        for batch in batches:
            for part in slices(batch, "text"):
                y, off = padded(part.column("text"), table)
                langs = np.array(part.column("lang").to_pylist(), object)
                own = np.repeat(np.arange(len(langs)), np.diff(off))
                for lang in sorted(set(langs)):
                    inside = (langs[own] == lang) if len(y) else np.zeros(0, bool)
                    inside[off[:-1]] = inside[off[:-1] + 1] = inside[off[:-1] + 2] = False
                    at = np.flatnonzero(inside)
                    if len(at):
                        k, c = np.unique(y[at - 3] << U64(48) | y[at - 2] << U64(32) | y[at - 1] << U64(16) | y[at], return_counts=True)
                        seen.setdefault(lang, []).append((k, c))
                        held += len(k)
                if held > 3_000_000:
                    yield from out()
                    held = 0
        yield from out()

    return count


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of docs (text, lang)."""
    parts = docs.select("text", "lang").mapInArrow(tidied(_counter(_letters())), "lang string, gram long, n long")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _find(keys: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of wanted grams in a sorted hash array, and which are there."""
    with np.errstate(over="ignore"):
        h = want * _ODD
    at = np.searchsorted(keys, h)
    at[at == len(keys)] = 0
    return at, keys[at] == h if len(keys) else np.zeros(len(h), bool)


def build_model(langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray) -> dict:
    """Interpolated Kneser-Ney over (language index, 4-gram, count) triples; gram as uint64."""
    ask = len(langs)
    tables: list[dict] = [{} for _ in range(ORDER + 1)]
    per: list[list] = [[None] * ask for _ in range(ORDER + 1)]
    for j in range(ask):
        own = lang == j
        g, c = gram[own], n[own].astype(float)
        per[ORDER][j] = (g, c)
        for k in range(ORDER - 1, 0, -1):  # continuation counts: each distinct longer gram counts once
            g, c = np.unique(g & U64((1 << (16 * k)) - 1), return_counts=True)
            per[k][j] = (g, c.astype(float))
    alphabet = len(np.unique(np.concatenate([per[1][j][0] for j in range(ask)]))) + 1
    lower_keys, lower = None, None
    for k in range(1, ORDER + 1):
        keys = np.unique(np.concatenate([per[k][j][0] for j in range(ask)]))
        ctx = np.unique(keys >> U64(16)) if k > 1 else np.zeros(1, np.uint64)
        gain, gamma = np.zeros((len(keys), ask)), np.ones((len(ctx), ask))
        for j in range(ask):
            g, c = per[k][j]
            if not len(g):
                continue
            n1, n2 = (c == 1).sum(), (c == 2).sum()
            d = _discount(n1, n2)
            own = np.searchsorted(ctx, g >> U64(16)) if k > 1 else np.zeros(len(g), np.int64)
            den, kinds = np.bincount(own, c, len(ctx)), np.bincount(own, minlength=len(ctx))
            gain[np.searchsorted(keys, g), j] = np.maximum(c - d, 0) / den[own]
            gamma[:, j] = np.where(den > 0, d * kinds / np.maximum(den, 1), 1)
        own = np.searchsorted(ctx, keys >> U64(16)) if k > 1 else np.zeros(len(keys), np.int64)
        below = 1 / alphabet if k == 1 else lower[np.searchsorted(lower_keys, keys & U64((1 << (16 * (k - 1))) - 1))]
        p = gain + gamma[own] * below
        with np.errstate(over="ignore"):
            hk, hc = keys * _ODD, ctx * _ODD
        a, b = np.argsort(hk), np.argsort(hc)
        tables[k] = {"keys": hk[a], "logp": np.log(p[a]).astype(np.float32), "ctx": hc[b], "back": np.log(gamma[b]).astype(np.float32)}
        lower_keys, lower = keys, p
    return {"langs": langs, "tables": tables, "unseen": float(np.log(1 / alphabet))}


def log_probs(model: dict, want: np.ndarray, k: int = ORDER) -> np.ndarray:
    """(positions, languages) log probabilities of the last character of each k-gram."""
    t = model["tables"][k]
    at, there = _find(t["keys"], want)
    out = t["logp"][at]
    miss = np.flatnonzero(~there)
    if len(miss):
        gone = want[miss]
        at, there = _find(t["ctx"], gone >> U64(16)) if k > 1 else (np.zeros(len(gone), np.int64), np.ones(len(gone), bool))
        back = np.where(there[:, None], t["back"][at], np.float32(0))
        out[miss] = back + (log_probs(model, gone & U64((1 << (16 * (k - 1))) - 1), k - 1) if k > 1 else np.float32(model["unseen"]))
    return out


def _discount(n1: float, n2: float) -> float:
    return min(0.95, max(0.1, n1 / (n1 + 2 * n2) if n1 else 0.5))


def _by_slot(rows: dict) -> dict:
    """{slot: (sorted keys, language of each, value of each)} of a part's rows."""
    key = rows["key"].view(np.uint64)
    order = np.lexsort((key, rows["slot"]))
    slot = rows["slot"][order]
    cuts = np.flatnonzero(np.diff(slot, prepend=-1))
    return {int(slot[a]): (key[at], rows["j"][at], rows["v"][at]) for a, b in zip(cuts, [*cuts[1:], len(slot)], strict=True) for at in [order[a:b]]}


def parted_model(counts: DataFrame, most: int) -> dict:
    """The model of build_model as rows (slot, key, language, value) in parts: slot k has a k-gram's own share, slot k + 8 the weight that its context leaves to the order below."""
    spark = counts.sparkSession
    tables, made = Tables(spark), []
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())
    index = spark.createDataFrame(list(zip(langs, range(len(langs)), strict=True)), "lang string, j int")
    level = counts.join(F.broadcast(index), "lang").select("j", "gram", F.col("n").cast("double").alias("c"))
    rows, base, alphabet = [], np.zeros(len(langs)), 0
    for k in range(ORDER, 0, -1):
        if k < ORDER:  # continuation counts: each distinct longer gram counts once
            level = tables.keep(level.groupBy("j", F.col("gram").bitwiseAND((1 << (16 * k)) - 1).alias("gram")).agg(F.count(F.lit(1)).cast("double").alias("c")))
            made.append(level)
        known = level.groupBy("j").agg(F.sum((F.col("c") == 1).cast("double")), F.sum((F.col("c") == 2).cast("double")), F.sum("c"), F.count(F.lit(1))).collect()
        facts = [(j, _discount(n1, n2), den, kinds) for j, n1, n2, den, kinds in known]
        if k == 1:
            alphabet = level.select("gram").distinct().count() + 1
            for j, d, den, kinds in facts:
                base[j] = d * kinds / den / alphabet
            share = level.join(F.broadcast(spark.createDataFrame(facts, "j int, d double, den double, kinds long")), "j")
        else:
            own = level.withColumn("ctx", F.shiftrightunsigned("gram", 16)).join(F.broadcast(spark.createDataFrame([f[:2] for f in facts], "j int, d double")), "j")
            stats = own.groupBy("j", "ctx").agg(F.sum("c").alias("den"), F.count(F.lit(1)).alias("kinds"), F.first("d").alias("d"))
            rows.append(stats.select(F.lit(k + 8).alias("slot"), F.col("ctx").alias("key"), "j", (F.col("d") * F.col("kinds") / F.col("den")).alias("v")))
            share = own.join(stats.select("j", "ctx", "den"), ["j", "ctx"])
        rows.append(share.select(F.lit(k).alias("slot"), F.col("gram").alias("key"), "j", (F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("den")).alias("v")))
    table = rows[0]
    for r in rows[1:]:
        table = table.unionByName(r)
    table = tables.keep(table)
    parts = Parts(table, ("slot", "key"), most, _by_slot)
    tables.drop(table, *made)
    return {"langs": langs, "base": base, "parts": parts}


def parted_log_probs(model: dict, want: np.ndarray) -> np.ndarray:
    """(4-grams, languages) log probabilities of the last character, as log_probs gives them."""
    asked = {}
    for k in range(1, ORDER + 1):
        g = want & U64((1 << (16 * k)) - 1) if k < ORDER else want
        asked[k] = np.unique(g, return_inverse=True)
        if k > 1:
            asked[k + 8] = np.unique(g >> U64(16), return_inverse=True)
    got = {s: np.full((len(keys), len(model["langs"])), float(s > 8)) for s, (keys, _) in asked.items()}
    for part in model["parts"]:
        for s, (have, lang, value) in part.items():
            keys = asked[s][0]
            a = np.searchsorted(have, keys)
            n = np.searchsorted(have, keys, "right") - a
            at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
            got[s][np.repeat(np.arange(len(keys)), n), lang[at]] = value[at]
    p = np.broadcast_to(model["base"], (len(want), len(model["langs"])))
    for k in range(1, ORDER + 1):
        p = got[k][asked[k][1]] + (p * got[k + 8][asked[k + 8][1]] if k > 1 else p)
    return np.log(p).astype(np.float32)


def _slab(model: dict, whole: int) -> int:
    """Bytes of text to look up at once: a pass over a parted model serves as many texts as its log probabilities allow."""
    return max(1 << 16, (32 << 20) // len(model["langs"])) if "parts" in model else whole


def entropies(model: dict, column, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy in nats a character, (texts, languages), and the number of characters (0 without letters)."""
    y, off = padded(column, table)
    total = np.zeros((len(off) - 1, len(model["langs"])))
    sizes = np.diff(off) - (ORDER - 1)
    owner = np.repeat(np.arange(len(sizes)), np.diff(off))
    real = np.ones(len(y), bool)
    for s in range(ORDER - 1):
        real[off[:-1] + s] = False
    if "parts" in model:
        known = np.unique(grams(y, ORDER - 1, len(y))) if len(y) else np.zeros(0, np.uint64)
        logs = parted_log_probs(model, known)
    for a in range(ORDER - 1, len(y), WINDOW):
        b = min(len(y), a + WINDOW)
        lp = logs[np.searchsorted(known, grams(y, a, b))] if "parts" in model else log_probs(model, grams(y, a, b))
        lp[~real[a:b]] = 0
        own = owner[a:b]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        total[own[first]] += np.add.reduceat(lp, first, axis=0, dtype=np.float64)
    letters = np.zeros(len(sizes), np.int64)
    np.add.at(letters, owner[np.flatnonzero(y != SPACE)], 1)
    sizes = np.where(letters > 0, sizes, 0)
    return -total / np.maximum(sizes, 1)[:, None], sizes


def calibrated(model: dict, texts: list[str], truth: list[str], table: np.ndarray) -> dict:
    """Adds a softmax temperature (least log loss) and a largest plausible entropy a language."""
    model = model | {"sharp": 20.0, "limit": [float("inf")] * len(model["langs"])}
    if not texts:
        return model
    column = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    got = [entropies(model, part.column("text"), table) for part in slices(column, "text", _slab(model, 1 << 40))]
    ce, size = (np.concatenate(x) for x in zip(*got, strict=True))
    y = np.array([model["langs"].index(t) if t in model["langs"] else -1 for t in truth])
    ok = (size > 0) & (y >= 0)
    ce, y = ce[ok], y[ok]
    if not len(y):
        return model

    def loss(sharp):
        z = -sharp * (ce - ce.min(1, keepdims=True))
        return -np.mean(np.log(np.maximum(np.exp(z[np.arange(len(y)), y]) / np.exp(z).sum(1), 1e-9)))

    model["sharp"] = float(min((0.5, 1, 2, 5, 10, 20, 50, 100), key=loss))
    for j in range(len(model["langs"])):
        own = ce[y == j, j]
        if len(own) >= 20:
            model["limit"][j] = float(1.1 * np.quantile(own, 0.995))
    return model


def _scorer(model: dict, table: np.ndarray, extra: list[str]):
    langs = np.array(model["langs"], object)

    def score(batches):
        for batch in batches:
            for part in slices(batch, "text", _slab(model, SLICE_BYTES)):
                ce, size = entropies(model, part.column("text"), table)
                best = ce.argmin(1)
                z = -model["sharp"] * (ce - ce.min(1, keepdims=True))
                p = 1 / np.exp(z).sum(1)
                some = size > 0
                low = ce[np.arange(len(best)), best]
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in extra] + [pa.array(np.where(some, langs[best], "und"), pa.string()), pa.array(np.where(some, p, 0.0)), pa.array(np.where(some, low, 0.0)), pa.array(some & (low <= np.array(model["limit"])[best]))],
                    [*extra, "lang_pred", "score", "cross_entropy", "accepted"],
                )

    return score


def _calibration(model: dict, held: DataFrame, most_bytes: int) -> dict:
    """What `calibrated` adds to a model, found by one task of an executor over rows (text, lang, o) in order of o until their texts come to `most_bytes`, one row at least."""
    rows = held.withColumn("_size", F.octet_length("text").cast("long")).repartition(1).sortWithinPartitions("o").select("text", "lang", "_size")
    parts = {k: v for k, v in model.items() if k == "parts"}  # broadcasts themselves
    shared = held.sparkSession.sparkContext.broadcast({k: v for k, v in model.items() if k != "parts"})
    table = _letters()

    def run(batches):
        texts, truth, size = [], [], 0
        for batch in batches:
            upto = size + np.cumsum(batch.column("_size").to_numpy())
            n = int(np.searchsorted(upto, most_bytes, "right")) or int(not texts and len(upto) > 0)
            texts += batch.column("text").slice(0, n).to_pylist()
            truth += batch.column("lang").slice(0, n).to_pylist()
            size = int(upto[-1]) if len(upto) else size
        m = calibrated(shared.value | parts, texts, truth, table)
        yield pa.RecordBatch.from_arrays([pa.array([m["sharp"]]), pa.array([m["limit"]], pa.list_(pa.float64()))], ["sharp", "limit"])

    got = rows.mapInArrow(tidied(run), "sharp double, limit array<double>").collect()  # one row
    return model | ({"sharp": got[0]["sharp"], "limit": list(got[0]["limit"])} if got else calibrated(model, [], [], table))


def train(docs: DataFrame, max_grams: int = 2_000_000, calibration_docs: int = 3000, calibration_bytes: int = 32_000_000) -> dict | None:
    """A model from docs (doc_id, text, lang), or None without training rows.

    Every row is counted. A slice by hash of the doc_id, of about `calibration_docs`
    rows and, in order of that hash, at most `calibration_bytes` of text, calibrates a
    model of the other rows first, in a task of an executor. A model of more than
    `max_grams` (language, gram) pairs is kept in parts of about so many rows.
    """
    docs = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = docs.count()
    share = int(min(0.1, calibration_docs / max(n, 1)) * (1 << 20))
    slot = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("calibration")), F.lit(1 << 20))
    tables = Tables(docs.sparkSession)
    counts = tables.keep(gram_counts(docs.filter(slot >= share)))
    order = F.struct(slot, "doc_id", F.md5("text")).alias("o")
    held = docs.filter(slot < share).select("text", "lang", order).orderBy("o", "lang").limit(2 * calibration_docs)
    first = _model_of(counts, max_grams) or {"langs": []}
    scale = _calibration(first, held, calibration_bytes) if first["langs"] else calibrated(first, [], [], _letters())
    if docs.filter(slot < share).isEmpty():
        return scale if scale["langs"] else None
    every = tables.keep(counts.unionByName(gram_counts(docs.filter(slot < share))).groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    model = _model_of(every, max_grams)
    tables.drop(counts, every)
    if model is None:
        return None
    limit = dict(zip(scale["langs"], scale["limit"], strict=True))
    return model | {"sharp": scale["sharp"], "limit": [limit.get(x, float("inf")) for x in model["langs"]]}


def _model_of(counts: DataFrame, max_grams: int) -> dict | None:
    """The model of (lang, gram, n), whole or in parts; None without rows."""
    if counts.count() > max_grams:
        return parted_model(counts, max_grams)
    rows = counts.toArrow()
    if rows.num_rows == 0:
        return None
    of = rows.column("lang").combine_chunks().dictionary_encode()
    langs = sorted(of.dictionary.to_pylist())
    lang = np.array([langs.index(x) for x in of.dictionary.to_pylist()])[of.indices.to_numpy()]
    return build_model(langs, lang, rows.column("gram").to_numpy().view(np.uint64), rows.column("n").to_numpy())


def identify(docs: DataFrame, model: dict | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs (text and the columns to keep) with lang_pred, score, cross_entropy, accepted."""
    no_clash(keep, ("lang_pred", "score", "cross_entropy", "accepted"))
    if model is None:
        return docs.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("cross_entropy"), F.lit(False).alias("accepted"))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    parts = {k: v for k, v in model.items() if k == "parts"}  # broadcasts themselves
    shared = docs.sparkSession.sparkContext.broadcast({k: v for k, v in model.items() if k != "parts"})
    table = _letters()

    def run(batches):
        return _scorer(shared.value | parts, table, list(keep))(batches)

    return docs.select(*keep, "text").mapInArrow(tidied(run), f"{kinds}, lang_pred string, score double, cross_entropy double, accepted boolean")


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    docs = docs.withColumn("held_out", held)
    model = train(docs.filter(~F.col("held_out")).select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "held_out", "text"), model, ("doc_id", "held_out"))
