"""Exact n-gram Jaccard self-join by universe partition, and its components.

A text is folded (A-Z to a-z, words joined by one blank). Texts alike in that form
are one class, named by 64 bits of a 128-bit digest; the other 64 bits show whether
two forms share a name, and then the names are drawn anew with another salt. A
class's set holds the hashes of its distinct 5-word shingles.

A pair that is linked differs in D tokens, D <= (a + b) (1 - t) / (1 + t). Sizes are
cut into bands [2^k, 2^(k+1)); a pair is met in the band of its smaller set, so a set
just above a band also signs in it. In a band the universe of hashes is cut into m
segments, of which the first n1 take one-deletion neighbourhoods; m and n1 come from
a cost model (signatures, those of few tokens weighing more, and the chance of the
case below). A set signs its segments in order, empty ones left out, until their
room exceeds the largest D that it can have in a link: room 1 for a segment, 2 for
one with its one-deletion neighbours (and two tokens at least). That is the subset
of segments it needs: before the first segment in which both sets of a linked pair
have a common signature, every other one is broken by as many differences as its
room, so neither set has stopped. A set that cannot reach that room also signs its
first tokens one by one, where the same holds with tokens as segments. So no link
is lost.

Signatures are combined within a task first: of the classes that share one there,
the first stands for the others, so that a signature that a third of all classes
have is a row a task. Of signatures that the same classes have, one is looked at.
Pairs of a signature's pivot (the class that has most company in its signatures) and
another that sizes and parity sketches (a lower bound of D) do not rule out are
verified: the shingles' bytes are compared, not their hashes. In signatures that then still hold several components, all pairs across components that sizes and sketches allow are verified
too, in blocks. A group of near copies thus costs about a pair a member, and yet two
components stay apart only when no pair joins them.

Null and wordless texts have an empty set and are linked with nothing. Fewer than
five words make one shingle. Ties do not occur: a component's id is its smallest
doc_id. Null doc_ids are allowed and never an id while another is there. Repeated
rows are rows of one class. An empty table gives no rows. Kept columns must not be
called n_shingles or component_id.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm._text import U64, Tables, flat, mix, no_clash, slices, span_hashes, tidied

SHINGLE = 5
SKETCH_BITS = 1024
#: Bits of the map of candidate classes that goes to all executors: 8 MB, whatever the input; further ones only weaken it.
MAP_BITS = 1 << 26
#: Signatures that a task combines at once.
COMBINE = 1 << 18
#: Classes of one signature that meet the others of it in one task.
BLOCK = 2048
_STEPS = [U64(pow(0xD1342543DE82EF95, i, 1 << 64)) for i in range(SHINGLE)]
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_PIECE = 8 << 20


def folded(text: bytes) -> bytes:
    """A-Z lower-cased, words `[^\\x20\\x09-\\x0D]+` joined by one blank; very long texts in pieces."""
    if len(text) <= _PIECE:
        return b" ".join(text.translate(_LOWER).split())
    out, at = [], 0
    while at < len(text):
        cut = _BLANK.search(text, min(at + _PIECE, len(text)))
        to = cut.start() if cut else len(text)
        out.append(b" ".join(text[at:to].translate(_LOWER).split()))
        at = to + 1
    return b" ".join(x for x in out if x)


def folded_rows(column) -> list[bytes]:
    data, off = flat(column)
    raw = data.tobytes()
    return [folded(raw[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]


def class_id(form: bytes, salt: int) -> tuple[int, int]:
    """(name, check) of a folded text; the name is never 0."""
    d = hashlib.blake2b(form, digest_size=16, salt=salt.to_bytes(8, "little")).digest()
    return int.from_bytes(d[:8], "little", signed=True) or 1, int.from_bytes(d[8:], "little", signed=True)


class Sets:
    """Shingle sets of folded, non-empty texts: distinct hashes, sorted in each text, and the bytes of each shingle's first place."""

    def __init__(self, forms: list[bytes]):
        self.data = np.frombuffer(b" ".join([*forms, b""]), np.uint8)
        size = np.fromiter((len(f) + 1 for f in forms), np.int64, len(forms))
        blank = np.flatnonzero(self.data == 32)
        starts = np.concatenate([[0], blank[:-1] + 1]) if len(blank) else blank
        word = np.searchsorted(starts, np.concatenate([[0], np.cumsum(size)]))
        count = np.diff(word)
        h = self._words(starts, blank)
        s = np.zeros(len(h), U64)
        with np.errstate(over="ignore"):
            n = len(h) - SHINGLE + 1
            if n > 0:
                s[:n] = h[:n]
                for k in range(1, SHINGLE):
                    s[:n] += h[k : n + k] * _STEPS[k]
                s[:n] = mix(s[:n])
            short = np.flatnonzero(count < SHINGLE)
            for i in short.tolist():  # the whole sequence is one
                a, b = word[i], word[i + 1]
                s[a] = mix(np.array([(h[a:b] * np.array(_STEPS[: b - a])).sum() + U64(b - a)], U64))[0]
        text = np.repeat(np.arange(len(forms)), count)
        first = np.arange(len(h)) - word[text]
        use = (first <= count[text] - SHINGLE) | ((first == 0) & (count[text] < SHINGLE))
        at = np.flatnonzero(use)
        at = at[np.lexsort((at, s[at], text[at]))]
        new = np.ones(len(at), bool)
        new[1:] = (s[at][1:] != s[at][:-1]) | (text[at][1:] != text[at][:-1])
        at = at[new]
        self.token, self.start = s[at], starts[at]
        self.end = blank[at + np.minimum(SHINGLE, count[text[at]]) - 1]
        self.off = np.searchsorted(text[at], np.arange(len(forms) + 1))

    def _words(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Word hashes, some bytes of text at a time."""
        out, at = np.empty(len(starts), U64), 0
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(starts, starts[at] + _PIECE)))
            base = starts[at]
            out[at:to] = span_hashes(self.data[base : ends[to - 1]], starts[at:to] - base, ends[at:to] - base)
            at = to
        return out

    def common(self, i: int, other: Sets, j: int) -> int:
        """Number of shingles that text i shares with text j of another; their bytes are compared."""
        a, b = slice(*self.off[i : i + 2]), slice(*other.off[j : j + 2])
        _, x, y = np.intersect1d(self.token[a], other.token[b], assume_unique=True, return_indices=True)
        s, t, n = self.start[a][x], other.start[b][y], (self.end - self.start)[a][x]
        fine = n == (other.end - other.start)[b][y]
        s, t, n = s[fine], t[fine], n[fine]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        wrong = self.data[np.repeat(s, n) + step] != other.data[np.repeat(t, n) + step]
        return len(n) - len(np.unique(np.repeat(np.arange(len(n)), n)[wrong]))


#: The cost model: chance that a token stands in a passage that unrelated texts share, and what a signature of only such tokens costs.
SHARED, COST = 0.3, 20.0


_plans: dict[tuple[int, int], tuple[int, int]] = {}


def allocate(band: int, percent: int) -> tuple[int, int]:
    """(m, n1) of least cost for sets of 2^band .. 2^(band+1) - 1 tokens."""
    if (band, percent) not in _plans:
        _plans[band, percent] = _cheapest(band, percent)
    return _plans[band, percent]


def _cheapest(band: int, percent: int) -> tuple[int, int]:
    low, top = 1 << band, (2 << band) - 1
    best = None
    for fill in (0.25, 0.5, 0.75, 1, 1.25, 1.5, 2, 2.5, 3, 3.5, 4, 5, 6, 8, 12):
        m = max(1, round(top / fill))
        for share in (0.0, 0.1, 0.25, 0.5, 1.0):
            n1, cost = round(share * min(m, top * (100 - percent) // percent + 1)), 0.0
            for size in (low, (low + top) // 2, top):
                need = size * (100 - percent) // percent + 1
                mean = size / m
                held = {k: math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) for k in range(1, int(mean + 6 * math.sqrt(mean) + 8))} if m > 1 else {size: 1.0}
                some = sum(held.values())
                weak = lambda k: 1 + COST * SHARED**k
                plain = sum(p * weak(k) for k, p in held.items())
                near = sum(p * (weak(k) + (k * weak(k - 1) if k > 1 else 0)) for k, p in held.items())
                double = sum(p * (2 if k > 1 else 1) for k, p in held.items())
                used = min(n1, need / double)
                rest = min(m - n1, max(0.0, need - used * double) / some)
                room = n1 * double + (m - n1) * some
                spread = math.sqrt(m * some * (1 - some) + n1 / 4) + 0.3
                poor = 0.5 * math.erfc((room - need + 0.5) / spread / math.sqrt(2))
                cost += used * near + rest * plain + poor * need * weak(1)
            if best is None or cost < best[0]:
                best = (cost, m, n1)
    return best[1], best[2]


def signatures(tok: np.ndarray, off: np.ndarray, percent: int = 80) -> tuple[np.ndarray, np.ndarray]:
    """(signature, text) of sets of sorted tokens: each in its band and, if a smaller partner can be there, in the band below."""
    sizes = np.diff(off)
    every = np.arange(len(sizes))
    owner = np.repeat(every, sizes)
    own = np.frexp(np.maximum(sizes, 1).astype(float))[1].astype(np.int64) - 1
    out = [(np.zeros(0, U64), np.zeros(0, np.int64))]
    for role in (0, 1):
        band = own - role
        top = (np.int64(2) << np.maximum(band, 0)) - 1
        fine = (sizes > 0) & (band >= 0)
        if role:
            fine &= sizes * percent <= 100 * top
        most = (top + sizes) * (100 - percent) // (100 + percent) if role else sizes * (100 - percent) // percent
        m, n1 = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for b in np.unique(band[fine]).tolist():
            m[band == b], n1[band == b] = allocate(b, percent)
        use = fine[owner]
        text, t = owner[use], tok[use]
        if not len(t):
            continue
        with np.errstate(over="ignore"):
            segment = ((t >> U64(32)) * m[text].astype(U64) >> U64(32)).astype(np.int64)  # tokens are sorted, so segments are runs
            new = np.ones(len(t), bool)
            new[1:] = (segment[1:] != segment[:-1]) | (text[1:] != text[:-1])
            first = np.flatnonzero(new)
            run = np.cumsum(new) - 1
            k = np.diff(np.append(first, len(t)))
            val = mix(t ^ U64(0x8EBC6AF09C88C6E3))
            total = np.concatenate([np.zeros(1, U64), np.cumsum(val)])
            sums = total[first + k] - total[first]
            of, number = text[first], segment[first]
            double = (number < n1[of]) & (k > 1)
            room = np.concatenate([[0], np.cumsum(1 + double)])
            lo, hi = np.searchsorted(of, every), np.searchsorted(of, every, "right")
            take = room[:-1] - room[lo[of]] <= most[of]
            salt = mix(band[of].astype(U64) << U64(40) | number.astype(U64))
            out.append((mix(sums[take] ^ salt[take]), of[take]))
            cut = (take & double)[run]
            out.append((mix((sums[run[cut]] - val[cut]) ^ salt[run[cut]]), text[cut]))
            poor = fine & (room[hi] - room[lo] <= most)
            at = np.flatnonzero(poor[text])
            at = at[at - np.searchsorted(text, every)[text[at]] <= most[text[at]]]
            out.append((mix(t[at] ^ mix(band[text[at]].astype(U64) ^ U64(0x589965CC75374CC3))), text[at]))
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def sketches(tok: np.ndarray, off: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Parity of the number of tokens in each of `bits` cells: rows of uint64 words. Differing bits bound the difference from below; halves of a sketch, by exclusive or, are the sketch of half as many cells."""
    out = np.zeros((len(off) - 1, bits // 64), U64)
    step = max(1, (1 << 20) // bits)
    for a in range(0, len(out), step):  # some texts at a time
        n = min(step, len(out) - a)
        text = np.repeat(np.arange(n), np.diff(off[a : a + n + 1]))
        cell = (mix(tok[off[a] : off[a + n]] ^ U64(0x1D8E4E27C47D124F)) % U64(bits)).astype(np.int64)
        odd = (np.bincount(text * bits + cell, minlength=n * bits) & 1).astype(np.uint8)
        out[a : a + n] = np.packbits(odd.reshape(n, bits), axis=1).view(U64)
    return out


def long_sketch(tok: np.ndarray) -> list[int] | None:
    """For a set of more tokens than SKETCH_BITS, a sketch of as many cells as tokens, to a power of two."""
    if len(tok) <= SKETCH_BITS:
        return None
    return sketches(tok, np.array([0, len(tok)]), 1 << (len(tok) - 1).bit_length())[0].view(np.int64).tolist()


def _fresh(forms: list[bytes], salt: int, seen: set[int]) -> tuple[list[tuple[int, int]], list[int]]:
    """(name, check) of each text ((0, 0) without words), and the rows whose class this task has not met."""
    ids = [class_id(f, salt) if f else (0, 0) for f in forms]
    return ids, [i for i, (c, _) in enumerate(ids) if c and not (c in seen or seen.add(c))]


def classes(docs: DataFrame, keep: tuple[str, ...], salt: int) -> DataFrame:
    """The kept columns with cid (null for the empty set); where a task meets a class first, also check, n, sketch and long."""
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                forms = folded_rows(part.column("text"))
                ids, rows = _fresh(forms, salt, seen)
                n = part.num_rows
                place = np.full(n, -1)
                place[rows] = np.arange(len(rows))
                if rows:
                    sets = Sets([forms[i] for i in rows])
                    sizes, sk = np.diff(sets.off), list(sketches(sets.token, sets.off).view(np.int64))
                    more = [long_sketch(sets.token[a:b]) for a, b in zip(sets.off[:-1], sets.off[1:], strict=True)]
                cid = np.array([c for c, _ in ids], np.int64)
                new = place < 0
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(c) for c in keep],
                        pa.array(cid, mask=cid == 0),
                        pa.array(np.array([x for _, x in ids], np.int64), mask=new),
                        pa.array(sizes[place] if rows else np.zeros(n, np.int64), mask=new),
                        pa.array([None if p < 0 else sk[p] for p in place.tolist()], pa.list_(pa.int64())),
                        pa.array([None if p < 0 else more[p] for p in place.tolist()], pa.list_(pa.int64())),
                    ],
                    [*keep, "cid", "check", "n", "sketch", "long"],
                )

    return docs.select(*keep, "text").mapInArrow(tidied(run), f"{kinds}, cid long, check long, n long, sketch array<long>, long array<long>")


def _index(salt, percent):
    """Texts to (sig, pivot, cid): of the classes that share a signature in the task, the first has pivot null, and all have it as pivot."""

    def combined(sig, cid):
        order = np.lexsort((cid, sig))
        sig, cid = sig[order], cid[order]
        new = np.ones(len(sig), bool)
        new[1:] = sig[1:] != sig[:-1]
        first = np.flatnonzero(new)
        many = np.diff(np.append(first, len(sig))) > 1
        run = np.cumsum(new) - 1
        pivot = cid[first][run]
        member = many[run] & ~((cid == pivot) & ~new)
        yield pa.RecordBatch.from_arrays([pa.array(sig[first]), pa.nulls(len(first), pa.int64()), pa.array(cid[first])], ["sig", "pivot", "cid"])
        yield pa.RecordBatch.from_arrays([pa.array(sig[member]), pa.array(pivot[member]), pa.array(cid[member])], ["sig", "pivot", "cid"])

    def run(batches):
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for part in slices(batch, "text"):
                forms = folded_rows(part.column("text"))
                ids, rows = _fresh(forms, salt, seen)
                if not rows:
                    continue
                sets = Sets([forms[i] for i in rows])
                sig, text = signatures(sets.token, sets.off, percent)
                held.append((sig.view(np.int64), np.array([ids[i][0] for i in rows], np.int64)[text]))
                if sum(len(x) for x, _ in held) > COMBINE:
                    yield from combined(*map(np.concatenate, zip(*held, strict=True)))
                    held = []
        if held:
            yield from combined(*map(np.concatenate, zip(*held, strict=True)))

    return run


def _shared(batches):
    """Rows (sig, pivot, cid), those without a pivot in order of sig and cid, to (sig, cid) of signatures that several classes have; a row may come twice."""
    last = None  # (sig, its first class, whether that stands alone so far)
    for batch in batches:
        lead = batch.column("pivot").is_null()
        known = batch.filter(batch.column("pivot").is_valid())
        if known.num_rows:
            yield known.select(["sig", "cid"])
        batch = batch.filter(lead)
        sig, cid = batch.column("sig").to_numpy(), batch.column("cid").to_numpy()
        if not len(sig):
            continue
        new = np.ones(len(sig), bool)
        new[1:] = sig[1:] != sig[:-1]
        new[0] = last is None or sig[0] != last[0]
        run = np.cumsum(new)  # 0: the run that the batch before began
        head = np.concatenate([[last[1] if last else 0], cid[new]])
        other = cid != head[run]
        some = np.bincount(run, weights=other, minlength=len(head)) > 0
        lone = np.ones(len(head), bool)
        lone[0] = last is None or last[2]
        own = np.concatenate([[0 if last is None else last[0]], sig[new]])
        both = np.flatnonzero(some & lone)  # their first class, once
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([own[both], sig[other]])), pa.array(np.concatenate([head[both], cid[other]]))], ["sig", "cid"])
        last = (sig[-1], head[run[-1]], bool(lone[run[-1]] and not some[run[-1]]))


def _class_map(ids: DataFrame) -> np.ndarray:
    """The bounded map of candidate classes."""
    slot = F.pmod(F.col("cid"), F.lit(MAP_BITS))
    words = ids.select(F.shiftright(slot, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(cid, {MAP_BITS}) % 64 as int))").alias("b")).groupBy("w").agg(F.expr("bit_or(b)").alias("b")).toArrow()
    out = np.zeros(MAP_BITS // 64, np.int64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return out.view(U64)


def _texts_of(shared, salt):
    """(cid, blob) of the marked classes, once a task; a blob is the compressed folded text."""

    def run(batches):
        marks, seen, pack = shared.value, set(), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in slices(batch, "text"):
                forms = folded_rows(part.column("text"))
                ids, rows = _fresh(forms, salt, seen)
                cid = np.array([ids[i][0] for i in rows], np.int64)
                slot = cid.view(U64) % U64(MAP_BITS)
                hit = np.flatnonzero((marks[(slot >> U64(6)).astype(np.int64)] >> (slot & U64(63))) & U64(1))
                if len(hit):
                    yield pa.RecordBatch.from_arrays([pa.array(cid[hit]), pa.array([pack.compress(forms[rows[i]]) for i in hit.tolist()], pa.binary())], ["cid", "blob"])

    return run


def _verify(percent):
    """Rows (pivot, part, cid, blob), each pivot's own first in its part, to linked pairs (a, b)."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        at, own, held = None, None, 0  # the pivot, the sets with its own one, and its place there
        for batch in batches:
            pivot, cid, blobs = batch.column("pivot").to_numpy(), batch.column("cid").to_numpy(), batch.column("blob")
            out: list[tuple[int, int]] = []
            a = 0
            while a < len(pivot):
                forms: list[bytes] = []
                size, b = 0, a
                while b < len(pivot) and (size < (1 << 20) or b == a):
                    forms.append(unpack.decompress(blobs[b].as_py()))
                    size += len(forms[-1])
                    b += 1
                sets = Sets(forms)
                for i in range(b - a):
                    p, c = int(pivot[a + i]), int(cid[a + i])
                    if c == p:
                        at, own, held = p, sets, i
                    elif p == at:
                        n, m = own.off[held + 1] - own.off[held], sets.off[i + 1] - sets.off[i]
                        same = own.common(held, sets, i)
                        if 100 * same >= percent * (n + m - same):
                            out.append((p, c))
                a = b
            x, y = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    return run


#: Partners that one verification group holds at most; a pivot with more has several groups.
GROUP = 256


def verified(docs: DataFrame, pairs: DataFrame, percent: int, salt: int, tables: Tables) -> DataFrame:
    """Linked pairs (a, b) of distinct pairs (pivot, cid); a pivot's partners are dealt to groups by a hash of their number.

    Texts of the pairs' classes are read again; only theirs are shuffled.
    """
    ends = pairs.select("cid").union(pairs.select(F.col("pivot").alias("cid"))).distinct()
    marks = docs.sparkSession.sparkContext.broadcast(_class_map(ends))
    texts = docs.select("text").mapInArrow(tidied(_texts_of(marks, salt)), "cid long, blob binary").groupBy("cid").agg(F.first("blob").alias("blob"))
    texts = tables.keep(texts)
    n = pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("parts"))
    partners = pairs.join(n, "pivot").select("pivot", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int").alias("part"), "cid")
    heads = n.select("pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("pivot").alias("cid"))
    rows = partners.union(heads).join(texts, "cid").select("pivot", "part", (F.col("cid") != F.col("pivot")).alias("partner"), "cid", "blob")
    found = tables.keep(rows.repartition("pivot", "part").sortWithinPartitions("pivot", "part", "partner").drop("partner").mapInArrow(tidied(_verify(percent)), "a long, b long"))
    marks.unpersist()
    tables.drop(texts)
    return found


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """(cid, label) of every end of an edge: label is the smallest cid that it reaches (large-star, small-star)."""
    e = tables.keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == mark:
            break
        mark = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        big = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).filter("u <> v")
        before, e = e, tables.keep(small.distinct())
        tables.drop(before)
    return e.select(F.col("u").alias("cid"), F.col("v").alias("label")).union(e.select(F.col("v").alias("cid"), F.col("v").alias("label")).distinct())


def plausible(pairs: DataFrame, slim: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs (pivot, cid) that sizes and sketches do not rule out; without false refusals."""
    other = slim.select(F.col("cid").alias("pivot"), *[F.col(c).alias(f"_{c}") for c in ("n", "sketch", "long")])
    p = pairs.select("pivot", "cid").join(slim, "cid").join(other, "pivot")
    apart = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, x: a + x) * (100 + percent) <= (F.col("n") + F.col("_n")) * (100 - percent)
    half = F.least(F.size("long"), F.size("_long"))
    cut = lambda x: F.when(F.size(x) > half, F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda a, b: a.bitwiseXOR(b))).otherwise(F.col(x))
    p = p.filter(100 * F.least("n", "_n") >= percent * F.greatest("n", "_n")).filter(apart("sketch", "_sketch"))  # so long sketches differ by a factor of two at most
    return p.filter(F.col("long").isNull() | F.col("_long").isNull() | apart(cut("long"), cut("_long"))).select("pivot", "cid")


def _across(percent):
    """Rows (sig, part, own, n, label, cid, sketch) in order of sig and part, a part's own block first, to the pairs of a block with all of the signature's classes in other components that size and sketch allow."""

    def scan(run, own, fresh, n, label, cid, sk):
        """Pairs at distance 1, 2, ... within runs, all runs at once; pairs of rows that are both not fresh have been met."""
        at = np.flatnonzero(own)
        step = 0
        while len(at):
            step += 1
            at = at[at + step < len(run)]
            at = at[run[at + step] == run[at]]
            to = at + step
            fine = (label[at] != label[to]) & (fresh[at] | fresh[to]) & (own[to] | (cid[at] < cid[to]))
            fine &= 100 * np.minimum(n[at], n[to]) >= percent * np.maximum(n[at], n[to])
            x, y = at[fine], to[fine]
            near = np.bitwise_count(sk[x] ^ sk[y]).sum(1, dtype=np.int64) * (100 + percent) <= (n[x] + n[y]) * (100 - percent)
            yield cid[x[near]], cid[y[near]]

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("sig", "part", "own", "n", "label", "cid")]
            new += [np.ones(batch.num_rows, bool), batch.column("sketch").flatten().to_numpy().reshape(batch.num_rows, -1).view(U64)]
            rows = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            sig, part, own, n, label, cid, fresh, sk = rows
            changed = np.ones(len(sig), bool)
            changed[1:] = (sig[1:] != sig[:-1]) | (part[1:] != part[:-1])
            number = np.cumsum(changed)
            pairs: set[tuple[int, int]] = set()
            for a, b in scan(number, own, fresh, n, label, cid, sk):
                pairs.update(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True))
            x, y = zip(*pairs, strict=True) if pairs else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["pivot", "cid"])
            stay = (number == number[-1]) & own  # the open part's block waits for the classes to come
            fresh[:] = False
            held = [x[stay] for x in rows]

    return run


def links(docs: DataFrame, slim: DataFrame, percent: int, salt: int, tables: Tables) -> DataFrame:
    """(cid, label) of linked classes, from verified links that connect every component (not every link within one). slim: (cid, n, sketch, long), a row a class."""
    signed = docs.select("text").mapInArrow(tidied(_index(salt, percent)), "sig long, pivot long, cid long")
    dealt = signed.repartition(F.when(F.col("pivot").isNull(), F.col("sig")).otherwise(F.xxhash64("sig", "cid")))
    live = tables.keep(dealt.sortWithinPartitions("sig", "cid").mapInArrow(tidied(_shared), "sig long, cid long").distinct())
    # a passage that the same classes share gives many signatures of the same classes: one of them says all
    mark = lambda seed: F.sum(F.xxhash64("cid", F.lit(seed)).cast("decimal(38,0)"))
    alike = live.groupBy("sig").agg(F.count(F.lit(1)).alias("k"), mark(1).alias("x"), mark(2).alias("y"))
    kept = alike.groupBy("k", "x", "y").agg(F.min("sig").alias("sig")).select("sig", "k")
    held = tables.keep(live.join(kept, "sig"))
    tables.drop(live)
    # a signature's pivot: the class with most company in all its signatures, as an original has among its copies
    company = held.groupBy("cid").agg(F.sum("k").alias("company"))
    pivots = held.join(company, "cid").groupBy("sig").agg(F.max(F.struct("company", "cid"))["cid"].alias("pivot"))
    stars = held.join(pivots, "sig").filter("pivot <> cid").groupBy(F.least("pivot", "cid").alias("a"), F.greatest("pivot", "cid").alias("b")).agg(F.max("pivot").alias("pivot"))
    tried = tables.keep(plausible(stars.select("pivot", F.when(F.col("pivot") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("cid")), slim, percent))
    found = verified(docs, tried, percent, salt, tables)
    label = tables.keep(components(found, tables))
    rows = held.filter("k > 2").join(label, "cid", "left").select("sig", "k", "cid", F.coalesce("label", "cid").alias("label"))
    split = rows.groupBy("sig").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a <> b").select("sig")
    rows = rows.join(split, "sig").join(slim.drop("long"), "cid").withColumn("blocks", F.ceil(F.col("k") / BLOCK).cast("int"))
    block = F.pmod(F.xxhash64("cid"), F.col("blocks"))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("sig", "part", (block == F.col("part")).alias("own"), "n", "label", "cid", "sketch")
    more = rows.repartition("sig", "part").sortWithinPartitions("sig", "part", F.desc("own")).mapInArrow(tidied(_across(percent)), "pivot long, cid long").distinct()
    done = tried.select(F.least("pivot", "cid").alias("pivot"), F.greatest("pivot", "cid").alias("cid"))
    more = tables.keep(plausible(more.join(done, ["pivot", "cid"], "left_anti"), slim, percent))
    tables.drop(held)
    if more.isEmpty():
        return label
    late = verified(docs, more, percent, salt, tables)
    return tables.keep(components(found.union(late), tables))


def cluster(docs: DataFrame, percent: int = 80, keep: tuple[str, ...] = ("doc_id",), label: str | None = None) -> DataFrame:
    """The kept columns (doc_id among them) with n_shingles and component_id; with `label` also a column of that name that tells components apart whatever their doc_ids (null for the empty set)."""
    no_clash(keep, ("n_shingles", "component_id", label))
    inner = {c: f"_keep_{i}" for i, c in enumerate(keep)}
    docs = docs.select("text", *[F.col(c).alias(n) for c, n in inner.items()])
    doc_id = inner["doc_id"]
    tables, salt = Tables(docs.sparkSession), 0
    while True:
        each = tables.keep(classes(docs, tuple(inner.values()), salt))
        known = each.filter(F.col("n").isNotNull()).groupBy("cid")
        slim = tables.keep(known.agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.max("long").alias("long"), (F.min("check") != F.max("check")).alias("mixed")))
        if slim.filter("mixed").isEmpty():
            break
        tables.drop(each, slim)
        salt += 1
    found = links(docs, slim.drop("mixed"), percent, salt, tables)
    least = each.filter(F.col("cid").isNotNull()).groupBy("cid").agg(F.min(doc_id).alias("least"))
    named = least.join(found, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    groups = named.groupBy("label").agg(F.min("least").alias("component_id"))
    home = named.select("cid", "label").join(groups, "label").join(slim.select("cid", "n"), "cid").select("cid", "label", F.col("n").alias("n_shingles"), "component_id")
    out = each.select(*inner.values(), "cid").join(home, "cid", "left")
    return out.select(*[F.col(n).alias(c) for c, n in inner.items()], F.coalesce("n_shingles", F.lit(0)).cast("long").alias("n_shingles"), F.coalesce("component_id", doc_id).alias("component_id"), *([F.col("label").alias(label)] if label else []))


def op8_ngram_join(spark, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
