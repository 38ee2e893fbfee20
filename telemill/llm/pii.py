"""Personal data: fixed patterns, and bootstrapped contextual extraction.

Base spans (e-mail, ip, card, phone) are seeds. Around every seed and every other
identifier-like token, lexical patterns are read: the two words before it, and
the words at either side. Spark scores the graph of patterns and instances for
a few rounds: a pattern's confidence in a kind is the confidence of its distinct
instances in it over their number, an instance's is that at least one of its
patterns is right (seeds stay at 1). Patterns with enough distinct seeds and
confidence then mark tokens that no fixed pattern finds.

Edges are distinct (pattern, instance) pairs, aggregated before the shuffle, so a
copied passage counts once however often it stands. All accepted patterns are
used; where they are more than `max_patterns`, tasks look theirs up in parts of so
many instead of holding all. Null texts are empty. Base spans are never changed;
further spans never overlap them. A pattern of two kinds has the one it is surer of,
then the one with more seeds, then the first listed; a token with patterns of several
kinds the first listed. Repeated rows have the same spans; an empty table gives no
rows, and none teach nothing. A column `pii` is replaced. A text is worked on whole: its
words take some 34 times its bytes of memory, about 100 times in text full of numbers.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm._text import Parts, Tables, flat, slices, tidied

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Equal to `[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)`, in linear time: a leftmost match begins where a run of digits does.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = "\"'`.,;:!?()[]{}<>|*&$%#"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > free and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at) if a < at else None
        if m:
            out.append((a, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind index, start, end) by kind, then start: leftmost, non-overlapping within a kind; what fails its check is dropped."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = "".join(c for c in m[0] if c not in " -") if len(m[0]) < 40 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_DIGIT.findall(m[0])) <= 15:
            out.append((3, *m.span()))
    return out


def _hash(*parts) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(parts).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


class Words:
    """A text's words, and the patterns around a place in it."""

    def __init__(self, text: str):
        self.text = text
        self.spans = [m.span() for m in _TOKEN.finditer(text)]
        self.starts, self.ends = [a for a, _ in self.spans], [b for _, b in self.spans]

    def patterns(self, a: int, b: int) -> list[int]:
        """Hashes of the two words before [a, b), and of the words at either side; what is left of a word beside the place counts as one."""
        k = bisect_left(self.starts, a)
        left = [self.text[s : min(e, a)].strip(_EDGE).lower() for s, e in self.spans[max(0, k - 2) : k]]
        k = bisect_right(self.ends, b)
        right = self.text[max(self.starts[k], b) : self.ends[k]].strip(_EDGE).lower() if k < len(self.spans) else ""
        out = []
        if len(left) == 2 and all(left):
            out.append(_hash("two", *left))
        if left and left[-1] and right:
            out.append(_hash("side", left[-1], right))
        return out


#: Groups of digits with one blank between them, as numbers are written.
_GROUPS = re.compile(r"(?<![^\x20\x09-\x0D])\(?[0-9][0-9().-]*+(?:\x20\(?[0-9][0-9().-]*+)+(?![^\x20\x09-\x0D,;:!?\]\"'])")


def candidates(words: Words, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Identifier-like tokens outside the base spans, in order: three digits or an @, five characters at least; groups of 7 to 15 digits in all are one."""
    taken = sorted((a, b) for _, a, b in base)
    text, out, k, after = words.text, [], 0, 0
    groups = []
    for m in _GROUPS.finditer(text):
        if 7 <= len(_DIGIT.findall(m[0])) <= 15:
            groups.append((m.start(), m.start() + len(m[0].rstrip("(.-"))))
    spots = [(a, b, False) for a, b in groups] + [(a, b, True) for a, b in words.spans]
    for a, b, whole in sorted(spots):
        if a < after:
            continue
        if whole:
            word = text[a:b]
            core = word.strip(_EDGE)
            if len(core) < 5 or "@" not in core and len(_DIGIT.findall(core)) < 3:
                continue
            a += word.index(core)
            b = a + len(core)
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if k == len(taken) or taken[k][0] >= b:
            out.append((a, b))
            after = b
    return out


def _marked(part: pa.RecordBatch) -> np.ndarray:
    """Rows whose text has a digit or an @."""
    data, off = flat(part.column("text"))
    table = np.zeros(256, np.int64)
    table[[ord(c) for c in "0123456789@"]] = 1
    seen = np.concatenate([[0], np.cumsum(table[data])])
    return seen[off[1:]] > seen[off[:-1]]


def _edges(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            rows: set[tuple[int, int, int]] = set()
            for i in np.flatnonzero(_marked(part)).tolist():
                text = part.column("text")[i].as_py()
                base = base_spans(text)
                words = Words(text)
                for kind, a, b in [*base, *((-1, a, b) for a, b in candidates(words, base))]:
                    value = _hash("value", text[a:b])
                    rows.update((p, value, kind) for p in words.patterns(a, b))
            cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32())], ["pattern", "instance", "kind"])


def learn(docs: DataFrame, rounds: int = 2, min_seeds: int = 5, min_confidence: float = 0.7, max_patterns: int = 200_000) -> dict[int, int] | Parts:
    """Accepted patterns (hash: kind index); where they are more than `max_patterns`, parts of (pattern, kind) of about so many each."""
    edges = docs.select("text").mapInArrow(tidied(_edges), "pattern long, instance long, kind int")
    tables = Tables(docs.sparkSession)
    edges = tables.keep(edges.groupBy("pattern", "instance", "kind").agg(F.lit(1).alias("one")).drop("one"))
    seeds = edges.filter("kind >= 0")
    support = seeds.groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("seeds")).filter(F.col("seeds") >= min_seeds)
    totals = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    strong = tables.keep(support.join(totals, "pattern"))
    open_edges = edges.filter("kind < 0").select("pattern", "instance")
    score = strong.withColumn("conf", F.col("seeds") / F.col("n"))
    for _ in range(rounds):
        doubt = F.sum(F.log(F.greatest(F.lit(1e-6), 1 - F.col("conf"))))
        found = open_edges.join(score.select("pattern", "kind", "conf"), "pattern").groupBy("instance", "kind").agg((1 - F.exp(doubt)).alias("belief"))
        gained = open_edges.join(found, "instance").groupBy("pattern", "kind").agg(F.sum("belief").alias("gain"))
        score = strong.join(gained, ["pattern", "kind"], "left").withColumn("conf", F.least(F.lit(1.0), (F.col("seeds") + F.coalesce("gain", F.lit(0.0)) * F.col("seeds") / F.col("n")) / F.col("n")))
    best = score.filter(F.col("conf") >= min_confidence).groupBy("pattern").agg(F.min(F.struct((-F.col("conf")).alias("conf"), (-F.col("seeds")).alias("seeds"), "kind")).alias("best"))
    best = tables.keep(best.select("pattern", F.col("best.kind").alias("kind")))
    tables.drop(edges, strong)
    parts = Parts(best, ("pattern",), max_patterns) if best.count() > max_patterns else None
    rows = best.toArrow() if parts is None else None
    tables.drop(best)
    return parts if parts is not None else dict(zip(rows.column("pattern").to_pylist(), rows.column("kind").to_pylist(), strict=True))


def _accepted(parts: Parts, batch: pa.RecordBatch) -> dict[int, int]:
    """The accepted patterns of the candidates in a batch."""
    own: set[int] = set()
    for part in slices(batch, "text"):
        for i in np.flatnonzero(_marked(part)).tolist():
            text = part.column("text")[i].as_py()
            words = Words(text)
            for a, b in candidates(words, base_spans(text)):
                own.update(words.patterns(a, b))
    want = np.fromiter(own, np.int64, len(own))
    out: dict[int, int] = {}
    for rows in parts if own else ():
        both, _, at = np.intersect1d(want, rows["pattern"], assume_unique=True, return_indices=True)
        out.update(zip(both.tolist(), rows["kind"][at].tolist(), strict=True))
    return out


def all_spans(text: str, model: dict[int, int]) -> list[tuple[int, int, int, bool]]:
    """(kind index, start, end, base) by kind, then start."""
    base = base_spans(text)
    out = [(k, a, b, True) for k, a, b in base]
    if model:
        words = Words(text)
        for a, b in candidates(words, base):
            kinds = [model[p] for p in words.patterns(a, b) if p in model]
            if kinds:
                out.append((min(kinds), a, b, False))
    return sorted(out)


def redacted(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    """Spans become [KIND]; overlapping ones become one mark, of the first kind."""
    out, at = [], 0
    for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def extract(docs: DataFrame, model: dict[int, int] | Parts | None = None, redact: bool = False) -> DataFrame:
    """All columns of docs with `pii`: array of (kind, start, end, base) in code points; with redact, text has the spans replaced."""
    model = learn(docs) if model is None else model
    shared = model if isinstance(model, Parts) else docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("pii")
    names = docs.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches):
        for batch in batches:
            m = _accepted(shared, batch) if isinstance(shared, Parts) else shared.value
            for part in slices(batch, "text"):
                found: list[list] = [[] for _ in range(part.num_rows)]
                texts = part.column("text")
                changed: dict[int, str] = {}
                for i in np.flatnonzero(_marked(part)).tolist():
                    text = texts[i].as_py()
                    spans = all_spans(text, m)
                    found[i] = [{"kind": KINDS[k], "start": a, "end": b, "base": own} for k, a, b, own in spans]
                    if spans and redact:
                        changed[i] = redacted(text, spans)
                if changed:
                    values = texts.to_pylist()
                    for i, t in changed.items():
                        values[i] = t
                    texts = pa.array(values, texts.type)
                cols = [texts if c == "text" else part.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(found, _FOUND)], [*names, "pii"])

    return docs.mapInArrow(tidied(run), f"{kinds}, pii array<struct<kind: string, start: bigint, end: bigint, base: boolean>>")


def digest(found: DataFrame) -> DataFrame:
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("pii", lambda x: x["base"] & (x["kind"] == kind))).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(joined(F.filter("pii", lambda x: x["base"])), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"))


def op3_pii(spark, sf_dir: str) -> DataFrame:
    return digest(extract(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
