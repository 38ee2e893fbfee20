"""Toxicity: a convolutional text classifier over hashed word embeddings.

Words are maximal runs free of ASCII white space, lower-cased (A-Z) and stripped of
all ASCII punctuation at both ends, unless they are nothing else. A word's
embedding is the sum of those of three hash buckets: the word, its first 4 and its
first 6 bytes, so that inflected and compound forms share evidence. Filters of
widths 1, 2 and 3 slide over the embeddings; the maximum of each filter over the
whole text feeds a logistic output. All labelled rows train, in shards of about
`shard_docs` rows, and of each as many at a time as come to `shard_bytes` of text: an
epoch fits a copy of the model to every shard, in a task each, and takes the mean of
the copies, of a bucket's embedding weighted by how often a shard has it. Epochs read
a table of the words' buckets, which are found once. Where all rows make one shard,
its task does all epochs. Only the model, whose size the number of buckets bounds,
reaches the driver. The score is Platt-scaled on a fifth of the rows, which do not
train, and thresholds by language come from the same rows, all of them: both from
sums that Spark makes.

Because pooling takes a maximum, buckets seen in fewer than `min_df` training
texts (and fewer than one in RARE) share the zero vector: a word never learned cannot raise a score, however
long the text. Null and empty texts have the score of no evidence. Without
labelled rows of both classes every score is 0. Repeated rows have the same score;
exact copies train once; of several labels of a doc_id the largest counts. An empty
table gives no rows. Ties do not occur.
"""

from __future__ import annotations

import pickle
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm._text import U64, Tables, flat, lower_ascii, slices, span_hashes, tidied, words

BITS, DIM, FILTERS, WIDTHS, PREFIXES = 18, 8, 8, (1, 2, 3), (4, 6)


def _trim() -> np.ndarray:
    t = np.zeros(256, bool)
    t[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
    return t


_BLANK = re.compile(rb"[\x20\x09-\x0D]")
EPOCHS, MIN_DF, SEED = 8, 8, 7
#: Beyond RARE times MIN_DF texts a bucket must be in one of so many: chance alone gives every bucket some words of many texts.
RARE = 600
#: Bytes of a text that are hashed at once.
PIECE = 4_000_000


def _stripped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of words without the marks at either end; words of marks alone as they are."""
    mark = _trim()[data]
    marked = np.flatnonzero(mark[starts] | mark[ends - 1])
    inner = np.flatnonzero(~mark)
    a, b = np.searchsorted(inner, starts[marked]), np.searchsorted(inner, ends[marked]) - 1
    some = a <= b
    out = starts.copy(), ends.copy()
    out[0][marked[some]], out[1][marked[some]] = inner[a[some]], inner[b[some]] + 1
    return out


def buckets(column) -> tuple[np.ndarray, np.ndarray]:
    """Three buckets a word (from 1; 0 is padding), and word offsets a text; a very long text, alone in its column, in pieces."""
    data, off = flat(column)
    if len(off) == 2 and len(data) > PIECE:
        raw, got, at = data.tobytes(), [], 0
        while at < len(raw):
            cut = _BLANK.search(raw, min(at + PIECE, len(raw)))
            to = cut.start() if cut else len(raw)
            got.append(_buckets(data[at:to], np.array([0, to - at]))[0])
            at = to
        ids = np.concatenate(got)
        return ids, np.array([0, len(ids)])
    return _buckets(data, off)


def _buckets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, woff = words(data, off)
    starts, ends = _stripped(data, starts, ends)
    low = lower_ascii()[data]
    h = [span_hashes(low, starts, ends)]
    for k in PREFIXES:  # of different lengths, so that hashes of whole words and prefixes differ by a salt
        h.append(span_hashes(low, starts, np.minimum(ends, starts + k)) * U64(2 * k + 1))
    return (np.stack(h, 1) >> U64(64 - BITS)).astype(np.int32) + 1, woff


def _gathered(texts: list[str], step: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """buckets() of a list, a few texts at a time: the hashing needs much more memory than its result."""
    got = [buckets(pa.array(texts[a : a + step], pa.string())) for a in range(0, len(texts), step)]
    ids = np.concatenate([g[0] for g in got])
    return ids, np.concatenate([[0], np.cumsum(np.concatenate([np.diff(g[1]) for g in got]))])


def _pad(ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two zero words before each text and after the last, so that no filter crosses texts and none is empty."""
    sizes, n = np.diff(off), len(off) - 1
    out = np.zeros((len(ids) + 2 * n + 2, ids.shape[1]), np.int32)
    out[np.arange(len(ids)) + 2 * (np.repeat(np.arange(n), sizes) + 1)] = ids
    return out, off[:-1] + 2 * np.arange(n)


#: Positions that filters are laid over at once when scoring; their outputs stay in a core's cache.
POSITIONS = 1 << 14


def _embedded(emb: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sums of the embeddings of each word's buckets."""
    e = emb.take(x[:, 0], 0)
    for c in range(1, x.shape[1]):
        e += emb.take(x[:, c], 0)
    return e


def _scored(model: dict, ids: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Largest filter outputs (texts, filters), some positions at a time."""
    x, first = _pad(model["map"][ids], off)
    n = len(x) - 2
    out = np.full((len(first), FILTERS * len(WIDTHS)), -np.inf, np.float32)
    for a in range(0, n, POSITIONS):
        b = min(n, a + POSITIONS)
        e = _embedded(model["emb"], x[a : b + 2])
        lo, hi = np.searchsorted(first, a, "right") - 1, np.searchsorted(first, b)
        cuts = np.maximum(first[lo:hi], a) - a
        y = [sum(e[k : k + b - a] @ kernel[k] for k in range(w)) for w, kernel in zip(WIDTHS, model["kernels"], strict=True)]
        out[lo:hi] = np.maximum(out[lo:hi], np.maximum.reduceat(np.concatenate(y, 1), cuts, axis=0))
    return out


def _pooled(model: dict, known: np.ndarray, off: np.ndarray):
    """Largest filter outputs a width (texts, filters), their first positions, the padded buckets and their embeddings; buckets are those of the model."""
    x, first = _pad(known, off)
    n = len(x) - 2
    e = _embedded(model["emb"], x)
    sizes = np.diff(np.append(first, n))
    own = np.repeat(np.arange(len(first)), sizes)
    best, places = [], []
    for w, kernel in zip(WIDTHS, model["kernels"], strict=True):
        y = sum(e[k : n + k] @ kernel[k] for k in range(w))
        top = np.maximum.reduceat(y, first, axis=0)
        best.append(top)
        at = np.zeros(top.shape, np.int64)
        hit, f = np.divmod(np.flatnonzero(y == np.repeat(top, sizes, 0))[::-1], FILTERS)
        at[own[hit], f] = hit
        places.append(at)
    return best, places, x, e


def _logit(model: dict, pooled: np.ndarray) -> np.ndarray:
    return np.maximum(pooled + model["bias"], 0) @ model["out"] + model["base"]


def _fresh(known: np.ndarray, rate: float, rng: np.random.Generator) -> dict:
    """A model before training, for the buckets that are known and a share of toxic texts."""
    where = np.zeros((1 << BITS) + 1, np.int32)
    where[known] = np.arange(1, len(known) + 1)
    return {
        "map": where,
        "emb": np.concatenate([np.zeros((1, DIM)), rng.normal(0, 0.1, (len(known), DIM))]).astype(np.float32),
        "kernels": [rng.normal(0, 0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
        "bias": np.zeros(FILTERS * len(WIDTHS), np.float32),
        "out": np.abs(rng.normal(0, 0.3, FILTERS * len(WIDTHS))).astype(np.float32),
        "base": np.float32(np.log(max(rate, 1e-3) / max(1 - rate, 1e-3))),
    }


def _document_counts(ids: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The number of texts that have each bucket."""
    df, last = np.zeros((1 << BITS) + 1, np.int64), np.zeros((1 << BITS) + 1, np.int32)
    for i in range(len(off) - 1):
        own = ids[off[i] : off[i + 1]].ravel()
        at = np.arange(len(own), dtype=np.int32)
        last[own] = at
        df[own[last[own] == at]] += 1
    return df


#: Numbers of a parameter that are changed at once, in a core's cache.
BLOCK = 1 << 14


def _step(q: np.ndarray, g: np.ndarray, m: np.ndarray, v: np.ndarray, number: int) -> None:
    """A step of Adam with weight decay, in place."""
    q, g, m, v = (a.reshape(-1) for a in (q, g, m, v))
    for a in range(0, len(q), BLOCK):
        qa, ga, ma, va = (x[a : a + BLOCK] for x in (q, g, m, v))
        t = ga - ma
        t *= 0.1
        ma += t
        np.square(ga, out=t)
        t -= va
        t *= 0.01
        va += t
        np.divide(va, 1 - 0.99**number, out=t)
        np.sqrt(t, out=t)
        t += 1e-6
        u = ma / (1 - 0.9**number)
        u *= 0.02
        u /= t
        np.multiply(qa, 1e-3, out=t)
        u += t
        qa -= u


def _adam(model: dict, known: np.ndarray, off: np.ndarray, y: np.ndarray, epochs: int, rng: np.random.Generator) -> None:
    """Adam on log loss over minibatches; it changes the model. The buckets are those of the model."""
    params = {"emb": model["emb"], "bias": model["bias"], "out": model["out"], **{f"k{i}": k for i, k in enumerate(model["kernels"])}}
    m = {k: np.zeros_like(v) for k, v in params.items()}
    v = {k: np.zeros_like(p) for k, p in params.items()}
    step, lengths, gemb = 0, np.diff(off), np.zeros_like(model["emb"])
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for a in range(0, len(order), 64):
            rows = order[a : a + 64]
            sizes = lengths[rows]
            take = np.repeat(off[rows] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            best, places, x, e = _pooled(model, known[take], np.concatenate([[0], np.cumsum(sizes)]))
            pooled = np.concatenate(best, 1)
            act = np.maximum(pooled + model["bias"], 0)
            p = 1 / (1 + np.exp(-(act @ model["out"] + model["base"])))
            d = (p - y[rows]) / len(rows)
            g = {"out": act.T @ d, "emb": gemb}
            dz = (d[:, None] * model["out"]) * (act > 0)
            g["bias"] = dz.sum(0)
            model["base"] -= np.float32(0.05 * d.sum())
            where, what = [], []
            for i, (w, kernel) in enumerate(zip(WIDTHS, model["kernels"], strict=True)):
                dw = dz[:, i * FILTERS : (i + 1) * FILTERS]
                gk = np.zeros_like(kernel)
                for k in range(w):
                    at = places[i] + k
                    for f in range(FILTERS):
                        gk[k, :, f] = e[at[:, f]].T @ dw[:, f]
                    where.append(x[at].transpose(1, 2, 0))  # (filters, buckets, texts)
                    part = dw.T[:, None, :, None] * kernel[k].T[:, None, None]
                    what.append(np.broadcast_to(part, (*where[-1].shape, DIM)))
                g[f"k{i}"] = gk
            gemb[:] = 0
            cells = np.concatenate([c.reshape(-1) for c in where])[:, None] * DIM + np.arange(DIM)
            np.add.at(gemb.reshape(-1), cells.reshape(-1), np.concatenate([c.reshape(-1) for c in what]))
            gemb[0] = 0
            step += 1
            for k, q in params.items():
                _step(q, g[k], m[k], v[k], step)


def fit(texts: list[str], toxic: np.ndarray, langs: list, epochs: int = EPOCHS, min_df: int = MIN_DF, seed: int = SEED) -> dict | None:
    """All epochs over one shard; the last fifth calibrates. Exact copies train once."""
    once = list({t: i for i, t in reversed(list(enumerate(texts)))}.values())[::-1]
    if not once or len(set(toxic[once].tolist())) < 2:
        return None
    rng = np.random.default_rng(seed)
    once = rng.permutation(once)
    cut = max(1, len(once) // 5)
    hold, use = once[:cut], once[cut:]
    ids, off = _gathered([texts[i] for i in use])
    y = toxic[use].astype(np.float32)
    model = _fresh(np.flatnonzero(_document_counts(ids, off) >= min_df), y.mean(), rng)
    _adam(model, model["map"][ids], off, y, epochs, rng)
    return _calibrate(model, [texts[i] for i in hold], toxic[hold], [langs[i] for i in hold])


def _calibrate(model: dict, texts: list[str], y: np.ndarray, langs: list) -> dict:
    """Platt scaling, then for each language the threshold of best F1 (0.5 with fewer than 20 texts or one class)."""
    z = np.concatenate([_logit(model, _scored(model, *buckets(pa.array(texts[a : a + 100], pa.string())))) for a in range(0, len(texts), 100)])
    a, b = 1.0, 0.0
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(300):
        p = 1 / (1 + np.exp(-(a * z + b)))
        a -= 0.05 * (np.mean((p - t) * z) + 0.001 * (a - 1))
        b -= 0.05 * np.mean(p - t)
    model |= {"a": max(a, 0.05), "b": b, "thresholds": {}}
    p = 1 / (1 + np.exp(-(model["a"] * z + model["b"])))
    for lang in sorted({x for x in langs if x is not None}):
        own = np.array([x == lang for x in langs])
        if own.sum() >= 20 and 0 < y[own].sum() < own.sum():
            f1 = lambda c: 2 * (y[own] * (p[own] >= c)).sum() / (y[own].sum() + (p[own] >= c).sum())
            cuts = np.arange(0.3, 0.71, 0.05)
            scores = np.array([f1(c) for c in cuts])
            good = cuts[scores >= scores.max() - 1e-12]
            model["thresholds"][lang] = float(good[np.abs(good - 0.5).argmin()])
    return model


def scores(model: dict, column) -> np.ndarray:
    """Probabilities of label 1 for whole texts."""
    z = _logit(model, _scored(model, *buckets(column)))
    return 1 / (1 + np.exp(-(model["a"] * z.astype(float) + model["b"])))


#: Parameters travel as whole numbers of this part of one, so that their sums do not depend on the order of shards.
UNIT = 2.0**-24


#: Room for the distinct words of a shard, so that its table is smaller than its texts.
DICTIONARY = {"parquet.dictionary.page.size": 8_000_000}


def _hashed(rows: DataFrame) -> DataFrame:
    """Rows of labelled texts with their words in place of the text: the three buckets of a word as one number, few of which are distinct."""
    kinds = "words array<bigint>, size long, toxic int, lang string, shard int, hold boolean"
    names = ("size", "toxic", "lang", "shard", "hold")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                ids, off = buckets(part.column("text"))
                packed = sum(ids[:, c].astype(np.int64) << (BITS + 1) * c for c in range(ids.shape[1]))
                listed = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(packed))
                yield pa.RecordBatch.from_arrays([listed, *map(part.column, names)], ["words", *names])

    return rows.select("text", F.octet_length("text").cast("long").alias("size"), "toxic", "lang", "shard", "hold").mapInArrow(tidied(run), kinds)


def _unhashed(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """buckets() of the texts, from their words as _hashed makes them."""
    off = column.offsets.to_numpy().astype(np.int64)
    packed = column.values.to_numpy()[off[0] : off[-1]]
    ids = np.empty((len(packed), 1 + len(PREFIXES)), np.int32)
    for c in range(ids.shape[1]):
        ids[:, c] = packed >> (BITS + 1) * c & ((1 << BITS + 1) - 1)
    return ids, off - off[0]


def _shards(batches, most: int):
    """(shard, buckets, word offsets, labels) of a task's hashed rows, which come by shard; a shard of more than `most` bytes of text in pieces."""
    shard, parts, counts, y, size = None, [], [], [], 0

    def taken():
        got = parts[0] if len(parts) == 1 else np.concatenate(parts), np.cumsum([0, *counts]), np.array(y, np.float32)
        for x in (parts, counts, y):
            x.clear()
        return got

    for batch in batches:
        ids, off = _unhashed(batch.column("words"))
        at = 0
        for i, (k, n, label) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("shard", "size", "toxic")], strict=True)):
            if y and (k != shard or size + n > most):
                parts.append(ids[off[at] : off[i]])
                yield shard, *taken()
                at, size = i, 0
            shard, size = k, size + n
            counts.append(off[i + 1] - off[i])
            y.append(label)
        parts.append(ids[off[at] :])
        del batch, ids
    if y:
        yield shard, *taken()


def _dense(model: dict) -> np.ndarray:
    """The parameters that every text has a part in, in rows of DIM."""
    flat_ = np.concatenate([*[k.ravel() for k in model["kernels"]], model["bias"], model["out"], [model["base"]]])
    return np.append(flat_, np.zeros(-len(flat_) % DIM)).reshape(-1, DIM)


def _with_dense(model: dict, rows: np.ndarray) -> dict:
    flat_, at, kernels = rows.ravel().astype(np.float32), 0, []
    for k in model["kernels"]:
        kernels.append(flat_[at : at + k.size].reshape(k.shape))
        at += k.size
    n = FILTERS * len(WIDTHS)
    return model | {"kernels": kernels, "bias": flat_[at : at + n].copy(), "out": flat_[at + n : at + 2 * n].copy(), "base": flat_[at + 2 * n]}


def _counted(rows: DataFrame, most: int) -> np.ndarray:
    """Texts that have each bucket, over all rows."""

    def run(batches):
        df = np.zeros((1 << BITS) + 1, np.int64)
        for _, ids, off, _ in _shards(batches, most):
            df += _document_counts(ids, off)
        has = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(df[has])], ["bucket", "n"])

    got = rows.mapInArrow(tidied(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((1 << BITS) + 1, np.int64)
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


def _averaged(rows: DataFrame, model: dict, number: int, most: int) -> dict:
    """The model after an epoch: the mean of what it becomes on each shard. Buckets that a shard lacks take no part in it."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    names = [f"v{i}" for i in range(DIM)]

    def run(batches):
        whole = shared.value
        for shard, ids, off, y in _shards(batches, most):
            known = whole["map"][ids]
            times = np.bincount(known.ravel(), minlength=len(whole["emb"]))
            times[0] = 0
            own = np.flatnonzero(times)
            del ids
            place = np.zeros(len(whole["emb"]), np.int32)
            place[own] = np.arange(1, len(own) + 1)
            mine = _with_dense(whole, _dense(whole)) | {"emb": whole["emb"][np.append(0, own)]}
            known = place[known]
            _adam(mine, known, off, y, 1, np.random.default_rng([SEED, number, shard]))
            dense = _dense(mine)
            key = np.concatenate([own, -1 - np.arange(len(dense))])
            weight = np.concatenate([times[own], np.full(len(dense), len(y))])
            values = np.rint(np.concatenate([mine["emb"][1:], dense]).astype(float) / UNIT).astype(np.int64) * weight[:, None]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(weight), *map(pa.array, values.T.copy())], ["key", "weight", *names])

    kinds = ", ".join(f"{n} long" for n in ("key", "weight", *names))
    got = rows.mapInArrow(tidied(run), kinds).groupBy("key").agg(*[F.sum(n).alias(n) for n in ("weight", *names)]).toArrow()
    shared.destroy()
    key = got["key"].to_numpy()
    mean = np.stack([got[n].to_numpy() for n in names], 1) / got["weight"].to_numpy()[:, None] * UNIT
    emb, dense = model["emb"].copy(), _dense(model)
    emb[key[key > 0]] = mean[key > 0]
    dense[-1 - key[key < 0]] = mean[key < 0]
    return _with_dense(model, dense) | {"emb": emb}


def _calibrated(tables: Tables, held: DataFrame, model: dict) -> dict:
    """_calibrate over rows of any number: Newton's method for the scale, with sums over all of them a step, and counts at each threshold by language."""
    shared = held.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "words"):
                z = _logit(shared.value, _scored(shared.value, *_unhashed(part.column("words")))).astype(float)
                yield pa.RecordBatch.from_arrays([pa.array(z), part.column("toxic"), part.column("lang")], ["z", "y", "lang"])

    seen = tables.keep(held.mapInArrow(tidied(run), "z double, y int, lang string"))
    n, ones = seen.agg(F.count("y"), F.coalesce(F.sum("y"), F.lit(0))).first()
    a, b = 1.0, 0.0
    t = F.when(F.col("y") == 1, (ones + 1) / (ones + 2)).otherwise(1 / (n - ones + 2))
    for _ in range(30 if n else 0):
        p = 1 / (1 + F.exp(-(a * F.col("z") + b)))
        w, z = p * (1 - p), F.col("z")
        ga, gb, haa, hab, hbb = seen.agg(*map(F.avg, ((p - t) * z, p - t, w * z * z, w * z, w))).first()
        step = np.linalg.solve([[haa + 1e-3, hab], [hab, hbb + 1e-9]], [ga + 1e-3 * (a - 1), gb])
        step *= min(1.0, 1 / np.abs(step).max()) if step.any() else 1.0
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    model = model | {"a": max(float(a), 0.05), "b": float(b), "thresholds": {}}
    cuts = [float(c) for c in np.arange(0.3, 0.71, 0.05)]
    p = 1 / (1 + F.exp(-(model["a"] * F.col("z") + model["b"])))
    yes = lambda c: F.count_if(p >= c)
    hit = lambda c: F.count_if((p >= c) & (F.col("y") == 1))
    f1 = F.array(*[2 * hit(c) / (F.sum("y") + yes(c)) for c in cuts])
    for lang, scores_ in seen.filter("lang is not null").groupBy("lang").agg(F.count("y").alias("n"), F.sum("y").alias("ones"), f1.alias("f1")).filter("n >= 20 and ones > 0 and ones < n").select("lang", "f1").collect():
        good = np.array(cuts)[np.array(scores_) >= max(scores_) - 1e-12]
        model["thresholds"][lang] = float(good[np.abs(good - 0.5).argmin()])
    tables.drop(seen)
    shared.destroy()
    return model


def train(docs: DataFrame, labels: DataFrame, shard_docs: int = 6000, shard_bytes: int = 64_000_000, sample_bytes: int | None = None) -> dict | None:
    """Fits on all labelled rows; a document with several labels takes the largest, and of exact copies the one first by a hash of doc_id trains.

    A shard has about `shard_docs` rows, and a task works on at most `shard_bytes` of text
    at once (`sample_bytes` is its former name; nothing is left out).
    """
    shard_bytes = sample_bytes or shard_bytes
    labels = labels.filter(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxic")), F.lit(1 << 20)).alias("place")
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.filter(F.col("text").isNotNull()).select("doc_id", F.sha2("text", 256).alias("sha"), "text", lang.alias("lang"), place)
    tables = Tables(docs.sparkSession)
    first = tables.keep(texts.select("doc_id", "sha", "place").join(labels, "doc_id").groupBy("sha").agg(F.min(F.struct("place", "doc_id", "toxic")).alias("x")).select("sha", "x.doc_id", "x.toxic"))
    n, kinds = first.agg(F.count("sha"), F.count_distinct("toxic")).first()
    if kinds < 2:
        tables.drop(first)
        return None
    shards = -(-n // shard_docs)
    both = ("doc_id", "sha")  # texts move once
    rows = texts.repartition(shards, *both).join(first.repartition(shards, *both), list(both)).dropDuplicates(list(both))
    hold = (F.pmod(F.xxhash64("sha"), F.lit(5)) == 0).alias("hold")
    rows = rows.select("text", "toxic", "lang", "place", "doc_id", "sha", F.spark_partition_id().alias("shard"), hold).sortWithinPartitions("place", "doc_id", "sha")
    kept = [first, tables.keep(rows) if shards == 1 else tables.keep(_hashed(rows), **DICTIONARY)]
    if shards == 1 and kept[-1].agg(F.sum(F.octet_length("text"))).first()[0] <= shard_bytes:
        model = _fitted(kept[-1])
    else:
        if shards == 1:
            kept.append(tables.keep(_hashed(kept[-1]), **DICTIONARY))
        rows = kept[-1]
        use = rows.filter("not hold").select("words", "size", "toxic", "shard")
        df, (m, ones) = _counted(use, shard_bytes), use.agg(F.count("toxic"), F.sum("toxic")).first()
        model = None
        if m and 0 < ones < m:
            model = _fresh(np.flatnonzero(df >= max(MIN_DF, -(-m // RARE))), ones / m, np.random.default_rng(SEED))
            for number in range(EPOCHS):
                model = _averaged(use, model, number, shard_bytes)
            model = _calibrated(tables, rows.filter("hold"), model)
    tables.drop(*kept)
    return model


def _fitted(rows: DataFrame) -> dict | None:
    """fit() on rows that make one shard, in a task."""
    order = ("place", "doc_id", "sha")

    def run(batches):
        texts, toxic, langs = [], [], []
        for batch in batches:
            for column, name in ((texts, "text"), (toxic, "toxic"), (langs, "lang")):
                column += batch.column(name).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(texts, np.array(toxic, np.int64), langs))], pa.binary())], ["model"])

    one = rows.repartition(1).sortWithinPartitions(*order).select("text", "toxic", "lang")
    got = one.mapInArrow(tidied(run), "model binary").collect()
    return pickle.loads(bytes(got[0][0])) if got else None


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """All columns of docs with toxicity (0 to 1) and toxic_rejected, by the threshold of the row's language; they replace columns of those names."""
    docs = docs.drop("toxicity", "toxic_rejected")
    if model is None:
        return docs.withColumns({"toxicity": F.lit(0.0), "toxic_rejected": F.lit(False)})
    names = docs.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                p = scores(m, part.column("text"))
                langs = part.column("lang").to_pylist() if "lang" in names else [None] * len(p)
                cut = np.array([m["thresholds"].get(x, 0.5) for x in langs])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p), pa.array(p >= cut)], [*names, "toxicity", "toxic_rejected"])

    return docs.mapInArrow(tidied(run), f"{kinds}, toxicity double, toxic_rejected boolean")


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0)
    model = train(docs.filter(~F.col("held_out")), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs.select("doc_id", "held_out", "text", "lang"), model)
    return out.select("doc_id", "held_out", F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"), "toxic_rejected")
