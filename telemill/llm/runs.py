"""Periodic runs of words: maximal repetitions, by a harmonic grid and prefix hashes.

A run is a stretch of consecutive words with smallest period q that is at least
max(least, 2 q) long and that no neighbouring word extends keeping q. A stretch of
period p and length 2 p or more holds a pair (i, i + p) with i a multiple of p, so the
grid of all such pairs, n ln n of them for n words, meets every run. Pairs whose words
differ, or that match neither half of the least stretch to either side, are left out;
for all others the longest common extensions to both sides are found by binary search
over prefix hashes, all pairs at once in numpy. Pairs of one run agree in its ends, and
multiples of the period too, so the smallest period of equal ends is the run's.

Hashes only ever make stretches too long. Every run is verified on its words, by code
and by byte; if one fails, the slice is worked on again with exact word numbers and
further hashes modulo primes, of new bases, until all hold.

Rows are worked on where they are, nothing is shuffled. Memory: a slice of texts (2 MB,
or one longer text: some 50 bytes a word) and PAIRS pairs. A null or empty text, or one
without words, has no run and the collapsed text is empty; repeated rows are rows each;
an empty table gives no rows. `keep` columns must not have the names of added ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.llm._text import U64, flat, no_clash, slices, span_hashes, tidied, words

#: Words of the shortest run.
LEAST = 12
#: Grid pairs that one vectorised step holds.
PAIRS = 1_000_000
ADDED = ("n_words", "runs", "collapsed")
WORD = r"[^\x20\x09-\x0D]+"


def _ragged(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the group, place in the group) for groups of these sizes."""
    group = np.repeat(np.arange(len(count)), count)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(count) - count, count)


class Prefixes:
    """Prefix hashes of a code sequence: modulo 2^64, and from the second attempt also modulo a prime, of random bases."""

    def __init__(self, codes: np.ndarray, attempt: int):
        rng = np.random.default_rng([13, attempt])
        base = U64(int(rng.integers(1 << 62)) * 2 + 1)
        with np.errstate(over="ignore"):
            self.power = np.concatenate([np.ones(1, U64), np.cumprod(np.full(len(codes), base, U64))])
            self.sums = np.concatenate([np.zeros(1, U64), np.cumsum(codes * self.power[:-1])])
        self.prime = None
        if attempt:
            self.prime = U64((1 << 31) - 1)
            step, power = int(rng.integers(1 << 20, 1 << 30)), np.ones(1, U64)
            while len(power) <= len(codes):
                power = np.concatenate([power, power * U64(pow(step, len(power), int(self.prime))) % self.prime])
            self.small_power = power[: len(codes) + 1]
            self.small = np.concatenate([np.zeros(1, U64), np.cumsum(codes % self.prime * self.small_power[:-1] % self.prime)]) % self.prime

    def same(self, i: np.ndarray, period: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the words from i on and those a period later agree for the length, as far as hashes tell."""
        j = i + period
        with np.errstate(over="ignore"):
            out = (self.sums[i + length] - self.sums[i]) * self.power[period] == self.sums[j + length] - self.sums[j]
        if self.prime is not None:
            p = self.prime
            out &= (self.small[i + length] + p - self.small[i]) % p * self.small_power[period] % p == (self.small[j + length] + p - self.small[j]) % p
        return out

    def reach(self, i: np.ndarray, period: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """The longest agreeing stretch from i on, or up to i, of at most `most` words."""
        got = np.zeros(len(i), np.int64)
        step = 1 << int(most.max(initial=0)).bit_length()
        while step := step >> 1:
            longer = got + step
            at = np.flatnonzero(longer <= most)
            begin = i[at] - longer[at] if back else i[at]
            fine = at[self.same(begin, period[at], longer[at])]
            got[fine] = longer[fine]
        return got


def _stretches(codes: np.ndarray, bounds: np.ndarray, least: int, hashes: Prefixes) -> np.ndarray:
    """Distinct (start, end, period) of maximal stretches that the grid meets, in words of the slice."""
    n = np.diff(bounds)
    docs = np.flatnonzero(n >= max(2, least))
    group, place = _ragged(n[docs] // 2)
    period, doc = place + 1, docs[group]
    count = (n[doc] - 1) // period
    found, total, at = [np.zeros((0, 3), np.int64)], np.cumsum(count), 0
    while at < len(count):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
        group, place = _ragged(count[at:to])
        p = period[at:to][group]
        i = bounds[doc[at:to]][group] + place * p
        at, of = to, doc[at:to]
        hit = np.flatnonzero(codes[i] == codes[i + p])
        i, p, group = i[hit], p[hit], group[hit]
        first, last = bounds[of][group], bounds[of + 1][group]
        need = np.maximum(p, least - p)
        ahead, behind = (need + 1) // 2, need // 2 + 1
        near = np.zeros(len(i), bool)
        room = np.flatnonzero(i + p + ahead <= last)
        near[room] = hashes.same(i[room], p[room], ahead[room])
        room = np.flatnonzero(~near & (i - behind >= first))
        near[room] = hashes.same(i[room] - behind[room], p[room], behind[room])
        i, p, first, last, need = (x[near] for x in (i, p, first, last, need))
        again = np.flatnonzero((i[1:] == i[:-1] + p[1:]) & (p[1:] == p[:-1]) & (first[1:] == first[:-1]))
        again = again[hashes.same(i[again], p[again], p[again])] + 1  # the pair before lies in the same stretch
        i, p, first, last, need = (np.delete(x, again) for x in (i, p, first, last, need))
        right, left = hashes.reach(i, p, last - i - p, False), hashes.reach(i, p, i - first, True)
        fine = left + right >= need
        found.append(np.unique(np.stack([i - left, i + p + right, p], 1)[fine], axis=0))
    return np.unique(np.concatenate(found), axis=0)


def _verified(data, starts, ends, codes: np.ndarray, found: np.ndarray) -> np.ndarray | None:
    """The runs among the stretches, or None if a hash was wrong: each run's words agree by code and byte, and other periods of its ends are multiples."""
    head = np.concatenate([[True], (np.diff(found[:, :2], axis=0) != 0).any(1)]) if len(found) else np.zeros(0, bool)
    runs = found[head]
    if (found[:, 2] % runs[np.cumsum(head) - 1, 2]).any():
        return None
    for part in np.array_split(runs, max(1, int((runs[:, 1] - runs[:, 0]).sum()) // PAIRS)):
        group, place = _ragged(part[:, 1] - part[:, 0] - part[:, 2])
        one = part[group, 0] + place
        two = one + part[group, 2]
        size = ends[one] - starts[one]
        if (codes[one] != codes[two]).any() or (size != ends[two] - starts[two]).any():
            return None
        for k in range(0, len(one), PAIRS // 8):
            group, place = _ragged(size[k : k + PAIRS // 8])
            if (data[starts[one[k:]][group] + place] != data[starts[two[k:]][group] + place]).any():
                return None
    return runs


def runs_of_words(data: np.ndarray, off: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, tuple]:
    """Runs (start, end, period) in word numbers of all texts of flat UTF-8, ordered by start and period, and the texts' words."""
    starts, ends, bounds = words(data, off)
    codes, attempt = span_hashes(data, starts, ends), 0
    while True:
        runs = _verified(data, starts, ends, codes, _stretches(codes, bounds, least, Prefixes(codes, attempt)))
        if runs is not None:
            return runs[np.lexsort((runs[:, 2], runs[:, 0]))], (starts, ends, bounds)
        attempt += 1
        raw = data.tobytes()
        spans = pa.array([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())
        codes = np.random.default_rng([7, attempt]).permutation(len(spans)).astype(U64)[spans.dictionary_encode().indices.to_numpy()]


def collapse(data: np.ndarray, off: np.ndarray, spans: tuple, runs: np.ndarray) -> pa.Array:
    """Texts with the first period of each run only, words joined by one space."""
    starts, ends, bounds = spans
    edge = np.zeros(len(starts) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    doc = np.searchsorted(bounds, kept, "right")
    joined = np.append(doc[1:] == doc[:-1], False) if len(kept) else np.zeros(0, bool)
    mark = np.zeros(len(data) + 2, np.int8)
    mark[starts[kept]] += 1
    np.add.at(mark, ends[kept] + joined, -1)
    mask = np.cumsum(mark[: len(data)], dtype=np.int8).astype(bool)
    text = data.copy()
    text[ends[kept[joined]]] = 0x20
    size = np.concatenate([[0], np.cumsum(mask)])[off].astype(np.int32)
    return pa.StringArray.from_buffers(len(off) - 1, pa.py_buffer(size.tobytes()), pa.py_buffer(text[mask].tobytes()))


def _listed(runs: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Runs as a list a text, with word numbers of the text."""
    at = np.searchsorted(runs[:, 0], bounds).astype(np.int32)
    own = np.repeat(bounds[:-1], np.diff(at))
    parts = [runs[:, 0] - own, runs[:, 1] - runs[:, 0], runs[:, 2]]
    return pa.ListArray.from_arrays(at, pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in parts], ["start", "length", "period"]))


def find_runs(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", least: int = LEAST) -> DataFrame:
    """The columns to keep, n_words, runs (an array of start, length and period by start, then period) and collapsed, the text without the repeated words."""
    no_clash(keep, ADDED)
    if least < 2:
        raise ValueError("a run has two words at least")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_text"):
                data, off = flat(part.column("_text"))
                runs, spans = runs_of_words(data, off, least)
                added = [pa.array(np.diff(spans[2]), pa.int64()), _listed(runs, spans[2]), collapse(data, off, spans, runs)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *added], [*keep, *ADDED])

    kept = docs.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in keep)
    return kept.mapInArrow(tidied(run), f"{schema}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the documents, by hash of doc_id, repeats a piece from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    d = docs.select("doc_id", "text", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("_w"), F.floor(h / 10).alias("_g"))
    n = F.size("_w")
    d = d.withColumn("_a", F.when(n > 0, F.col("_g") % n).cast("int"))
    d = d.withColumn("_p", (1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int"))
    again = F.transform(F.sequence(F.lit(0), n - F.col("_a") - 1), lambda i: F.get("_w", F.col("_a") + i % F.col("_p")))
    return d.select("doc_id", F.when(n > 0, F.array_join(F.concat(F.slice("_w", 1, F.col("_a")), again), " ")).otherwise(F.col("text")).alias("text"))


def _digest(runs: Column) -> Column:
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return F.sha2(F.array_join(lines, ""), 256)


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = find_runs(planted(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    d = found.withColumn("_best", best)
    length, period = -F.col("_best.l"), F.col("_best.p")
    return d.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_best.s").alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        _digest(F.col("runs")).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
