"""Secret scans over a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived (an
AND of ORs of ANDs, from its parse tree). Every block of rows gets an inverted
index of the trigrams that the queries name: a posting list, as a bitmap over
the block's rows, for each. Rules intersect and unite postings, and only the
candidates are verified with the expression; rules without mandatory trigrams
scan every row. Text and trigrams are folded to lower case, so a query never
misses a match in either case.

Null texts are empty; a rule's matches do not overlap, and spans that begin together
are in order of rules. Repeated rows are scanned each; an empty table gives no rows.
All rules take time in proportion to a text's length. Blocks are slices of an input partition: nothing is
shuffled, and no text is cut.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm._text import flat, lower_ascii, no_clash, slices, tidied


@dataclass(frozen=True)
class Rule:
    """A kind of secret. least: shortest length of `group` for a match to count; scan: a byte class whose long runs stand for the whole pattern."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    scan: str = ""


#: The base rules, in the order in which their spans are listed.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24, "0123456789abcdef"),
)
#: Rules that add spans: well-known shapes of credentials with fixed prefixes.
MORE = (
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
    Rule("git_token", r"(?:ghp|gho|ghs|ghr)_[A-Za-z0-9]{36}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"(?i:authorization:\x20*bearer)\x20+[A-Za-z0-9._~+/=-]{16,}"),
)


def trigram_query(pattern: str):
    """("all",), or ("tri", t), ("and", [...]) or ("or", [...]) that any text with a match satisfies (lower-cased)."""
    parser = re._parser
    tree = parser.parse(pattern, re.A)

    def both(qs):
        qs = [q for q in qs if q != ("all",)]
        return qs[0] if len(qs) == 1 else ("and", qs) if qs else ("all",)

    def either(qs):
        return ("all",) if any(q == ("all",) for q in qs) else qs[0] if len(qs) == 1 else ("or", qs)

    def of(strings):
        """Query of exact strings: one of them stands in the text."""
        return either([both([("tri", s[i : i + 3]) for i in range(len(s) - 2) if s[i : i + 3].isascii()]) for s in sorted(strings)])

    def walk(items):
        """(query, exact strings of the node or None)"""
        queries, run = [], {""}
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                got = ({chr(arg).lower()}, ("all",))
            elif name == "IN" and len(arg) <= 16 and all(str(k) == "LITERAL" for k, _ in arg):
                got = ({chr(c).lower() for _, c in arg}, ("all",))
            elif name == "SUBPATTERN":
                q, exact = walk(arg[3])
                got = (exact, q)
            elif name == "BRANCH":
                parts = [walk(b) for b in arg[1]]
                exact = set().union(*[p[1] for p in parts]) if all(p[1] is not None for p in parts) else None
                got = (exact, either([both([p[0], of(p[1])]) if p[1] is not None else p[0] for p in parts]))
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                low, high, inner = arg
                q, exact = walk(inner)
                if low == 0:
                    got = (exact | {""} if exact is not None and high == 1 else None, ("all",))
                else:
                    got = (exact if low == high == 1 else None, both([q, of(exact)]) if exact is not None else q)
            elif name == "AT":
                got = ({""}, ("all",))
            else:
                got = (None, ("all",))
            exact, q = got
            if exact is not None and len(run) * len(exact) <= 64:
                run = {a + b for a in run for b in exact}
                continue
            queries += [of(run), q]
            run = set(exact) if exact is not None else {""}  # what comes next starts a run of its own
        if not queries:
            return ("all",), run
        return both([*queries, of(run)]), None

    q, exact = walk(tree)
    return both([q, of(exact)]) if exact is not None else q


def _tris(q) -> set[str]:
    return {q[1]} if q[0] == "tri" else set().union(*map(_tris, q[1])) if q[0] in ("and", "or") else set()


class Index:
    """Posting bitmaps over the rows of one block for the trigrams of all queries."""

    def __init__(self, slots: np.ndarray, n: int, data: np.ndarray, off: np.ndarray):
        low = lower_ascii()[data].astype(np.uint32)
        rows = len(off) - 1
        self.bits = np.zeros((n, rows), bool)
        if len(low) >= 3:
            slot = slots[low[:-2] << 16 | low[1:-1] << 8 | low[2:]]
            at = np.flatnonzero(slot)
            row = np.searchsorted(off, at, "right") - 1
            inside = at + 2 < off[row + 1]
            self.bits[slot[at[inside]] - 1, row[inside]] = True

    def match(self, q, place: dict[str, int]) -> np.ndarray:
        if q[0] == "tri":
            return self.bits[place[q[1]]]
        if q[0] == "all":
            return np.ones(self.bits.shape[1], bool)
        parts = [self.match(x, place) for x in q[1]]
        return np.logical_and.reduce(parts) if q[0] == "and" else np.logical_or.reduce(parts)


def _runs(data: np.ndarray, off: np.ndarray, scan: str, least: int) -> np.ndarray:
    """Rows that hold a run of at least `least` bytes of the class."""
    table = np.zeros(256, bool)
    table[[ord(c) for c in scan]] = True
    inside = table[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    some = np.diff(off) > 0
    before[off[:-1][some]] = after[off[1:][some] - 1] = False  # runs end with their text
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    long = starts[ends - starts >= least]
    out = np.zeros(len(off) - 1, bool)
    out[np.searchsorted(off, long, "right") - 1] = True
    return out


def spans_of(rule: Rule, compiled: re.Pattern, text: str) -> list[tuple[int, int]]:
    return [m.span() for m in compiled.finditer(text) if len(m[rule.group]) >= rule.least]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and `found`: array of (kind, start, end) in code points, end exclusive, by start, then order of rules."""
    no_clash(keep, ("found",))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    queries = [trigram_query(r.pattern) for r in rules]
    names = sorted({t for q in queries for t in _tris(q)})
    place = {t: i for i, t in enumerate(names)}
    found_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        compiled = [re.compile(r.pattern, re.A) for r in rules]
        slots = np.zeros(1 << 24, np.uint16)
        for t, i in place.items():
            a, b, c = t.encode("ascii")
            slots[a << 16 | b << 8 | c] = i + 1
        for batch in batches:
            for part in slices(batch, "text"):
                data, off = flat(part.column("text"))
                index = Index(slots, len(names), data, off)
                out: list[list] = [[] for _ in range(part.num_rows)]
                texts: dict[int, str] = {}
                for order, (rule, q, pattern) in enumerate(zip(rules, queries, compiled, strict=True)):
                    rows = _runs(data, off, rule.scan, rule.least) if q == ("all",) and rule.scan else index.match(q, place)
                    for i in np.flatnonzero(rows).tolist():
                        if i not in texts:
                            texts[i] = data[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace")
                        out[i] += [(a, order, b) for a, b in spans_of(rule, pattern, texts[i])]
                found = [[{"kind": rules[o].kind, "start": a, "end": b} for a, o, b in sorted(x)] for x in out]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(found, found_type)], [*keep, "found"])

    return docs.select(*keep, "text").mapInArrow(tidied(run), f"{kinds}, found array<struct<kind: string, start: bigint, end: bigint>>")


def digest(found: DataFrame) -> DataFrame:
    base = [r.kind for r in BASE]
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    own = F.filter("found", lambda x: x["kind"].isin(*base))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in base], F.sha2(joined(own), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    return digest(scan(spark.read.parquet(f"{sf_dir}/documents.parquet")))
