"""Packing: vector bin packing of tokenised examples by the dot-product heuristic.

A sequence has three limits: tokens, segments and loss-bearing tokens. Each
document is tokenised and closed by an end id; runs of `capacity` tokens, or of as
many as `max_loss` allows, are cut off, and the remainder is one item. Runs of
`capacity` tokens fill a sequence each; other pieces are items. Items are packed
within bounded windows of one input partition, so nothing is shuffled (unless an order
of documents is given, which sequences then keep): for an open
sequence the item that fits and has the largest dot product of its demand with
the sequence's remaining room (both as shares of the limits) goes in next; ties
go to the earlier item. Output depends only on the order of rows in a partition.

Where a column of spans says which text bears loss, a token does if its first byte
lies in one; the end id never. Without it all tokens bear loss but the first of a
segment, which has nothing before it to be predicted from.

Tokenisation splits a batch into the vocabulary's pre-tokens with array
operations, has the `tokenizers` model encode each distinct pre-token once (told
apart by its bytes), and gathers the ids; they equal the tokenizer's own (tested
against it). As in the tokenizer's default state, a text is first split at the
file's added tokens, each of which is one id. Null texts are empty: their only id is
the end id. Repeated rows are packed each. An empty table gives no rows. Columns to
keep must not have the names of added ones. A text is tokenised whole, in some 25 bytes
of memory a byte; its ids are cut into pieces.
"""

from __future__ import annotations

import json
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm._text import U64, codepoints, flat, no_clash, slices, span_hashes, tidied

LETTER, NUMBER, OTHER, SPACE = range(4)
#: Items packed together at most; bounds a task's memory (their ids are held).
WINDOW_ITEMS = 4096
#: Distinct pre-tokens that a worker remembers, over its tasks, before it starts afresh: some 70 MB.
MEMO = 1_000_000


def char_classes() -> np.ndarray:
    """Class of each code point as the byte-level vocabulary's split pattern sees it."""
    import regex

    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "�" for c in range(0x110000))
    out = np.full(0x110000, OTHER, np.int8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


def pretoken_starts(cps: np.ndarray, off: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Places where pre-tokens begin: contractions, runs of letters, numbers or marks with one leading blank, white space."""
    n = len(cps)
    if n == 0:
        return np.zeros(0, np.int64)
    kind = classes[cps]
    first = np.zeros(n + 1, bool)
    first[off[:-1]] = True
    first[n] = True
    first, edge = first[:n], first[1:]  # edge: last of its text
    prev = np.empty_like(kind)
    prev[0], prev[1:] = -1, kind[:-1]
    prev[first] = -1
    follow = np.empty_like(kind)
    follow[-1], follow[:-1] = -1, kind[1:]
    follow[edge] = -1
    blank = cps == 0x20
    after_blank = np.empty(n, bool)
    after_blank[0], after_blank[1:] = False, blank[:-1]
    after_blank &= ~first
    space = kind == SPACE
    start = np.where(space, (prev != SPACE) | ((follow != SPACE) & (follow != -1)), (kind != prev) & ~after_blank)
    start |= first
    quotes = np.flatnonzero((cps == 0x27) & start & (follow == LETTER))
    if len(quotes):
        text_end = off[np.searchsorted(off, quotes, "right")]
        a = cps[quotes + 1]
        two = quotes + 2 < text_end
        b = np.where(two, cps[np.minimum(quotes + 2, n - 1)], 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        pair = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        size = np.where(one, 2, np.where(pair & two, 3, 0))
        hit = size > 0
        start[quotes[hit] + 1] = False
        ends = quotes[hit] + size[hit]
        inside = ends < text_end[hit]
        start[ends[inside]] = True
        # a quote right after a contraction begins a pre-token by itself, as classes differ there
    return np.flatnonzero(start)


def byte_alphabet() -> str:
    """The characters by which a byte-level vocabulary writes the 256 bytes: a byte's own where that is printable, else the next from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return "".join(chr(b) if b in set(plain) else chr(256 + rest.index(b)) for b in range(256))


def added_tokens(content: str) -> dict[bytes, int]:
    """Byte strings of a tokenizer file's added tokens and their ids."""
    tokens = json.loads(content).get("added_tokens", [])
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in tokens):
        raise ValueError("added tokens that depend on the text around them")
    return {t["content"].encode(): t["id"] for t in tokens}


def equal_spans(data: np.ndarray, a: np.ndarray, other: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the bytes of spans at a in data and at b in another array, of the same sizes, are equal. Both arrays end in eight bytes more."""
    x, y = (np.ndarray((len(d) - 7,), "<u8", d, 0, (1,)) for d in (data, other))
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
    out, more, at = np.ones(len(a), bool), np.flatnonzero(size > 0), 0
    while len(more):
        out[more[((x[a[more] + at] ^ y[b[more] + at]) & masks[np.minimum(size[more] - at, 8)]) != 0]] = False
        at += 8
        more = more[(size[more] > at) & out[more]]
    return out


def _grown(x: np.ndarray, used: int, more: int) -> np.ndarray:
    """The array, or a copy with room for `more` beyond the `used` ones and eight."""
    return x if used + more + 8 <= len(x) else np.concatenate([x, np.zeros(max(len(x), more + 8), x.dtype)])


class Encoder:
    """Ids of whole texts, equal to the tokenizer's, by encoding each distinct pre-token once. content: that of a tokenizer file; encode_special_tokens as the tokenizer's: added tokens in texts are plain text; classes: char_classes(), if known."""

    def __init__(self, content: str, encode_special_tokens: bool = True, classes: np.ndarray | None = None):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(content)
        self.model, self.alphabet = tokenizer.model, byte_alphabet()
        byte = {c: b for b, c in enumerate(self.alphabet)}
        known = tokenizer.get_vocab(with_added_tokens=True)
        every = added_tokens(content)
        self.width = np.ones(max(known.values()) + 1, np.int64)  # bytes of text a token stands for
        for token, i in known.items():
            self.width[i] = len(token) if all(c in byte for c in token) and token.encode() not in every else len(token.encode())
        self.added = {} if encode_special_tokens else every
        literal = b"|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))  # the longest of those that begin at a place
        self.literal, self.anywhere = (re.compile(literal), re.compile(b"(?=" + literal + b")")) if literal else (None, None)
        self.classes = char_classes() if classes is None else classes
        self.clear()

    def clear(self):
        """Forgets all pre-tokens: their hashes in order and entries, and each entry's bytes and ids."""
        self.hash, self.entry = np.zeros(0, U64), np.zeros(0, np.int64)
        self.known = self.n_bytes = self.n_ids = 0
        self.bytes, self.ids = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint32)
        self.byte_at, self.byte_size, self.id_at, self.id_size = (np.zeros(1 << 16, np.int64) for _ in range(4))

    def _learn(self, pieces: list[bytes]) -> np.ndarray:
        """New entries of pre-tokens."""
        text = b"".join(pieces)
        width = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(width)
        written, one = text.decode("latin-1").translate(self.alphabet), self.model.tokenize
        got = [one(written[a:b]) for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]
        ids = [[t.id for t in g] for g in got] if self.added else None
        for token, i in self.added.items():
            for k in [k for k, p in enumerate(pieces) if p == token]:
                ids[k] = [i]
        size = np.fromiter(map(len, ids or got), np.int64, len(pieces))
        flat = [i for g in ids for i in g] if ids else [t.id for g in got for t in g]
        n = len(pieces)
        self.bytes, self.ids = _grown(self.bytes, self.n_bytes, len(text)), _grown(self.ids, self.n_ids, len(flat))
        self.byte_at, self.byte_size, self.id_at, self.id_size = (_grown(x, self.known, n) for x in (self.byte_at, self.byte_size, self.id_at, self.id_size))
        own = np.arange(self.known, self.known + n)
        self.bytes[self.n_bytes : self.n_bytes + len(text)] = np.frombuffer(text, np.uint8)
        self.ids[self.n_ids : self.n_ids + len(flat)] = flat
        self.byte_at[own], self.byte_size[own] = self.n_bytes + ends - width, width
        self.id_at[own], self.id_size[own] = self.n_ids + np.cumsum(size) - size, size
        self.known, self.n_bytes, self.n_ids = self.known + n, self.n_bytes + len(text), self.n_ids + len(flat)
        return own

    def _entries(self, raw: bytes, data: np.ndarray, keys: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The entry of each pre-token, of distinct hashes in order; new ones are learned. One whose hash another pre-token has gets an entry of its own."""
        k = np.searchsorted(self.hash, keys)
        hit = np.zeros(len(keys), bool)
        inside = k < len(self.hash)
        hit[inside] = self.hash[k[inside]] == keys[inside]
        out = np.full(len(keys), -1)
        out[hit] = self.entry[k[hit]]
        old = out[hit]
        out[np.flatnonzero(hit)[(self.byte_size[old] != size[hit]) | ~equal_spans(data, at[hit], self.bytes, self.byte_at[old], np.minimum(size[hit], self.byte_size[old]))]] = -1
        miss = np.flatnonzero(out < 0)
        if len(miss):
            out[miss] = self._learn([raw[a : a + n] for a, n in zip(at[miss].tolist(), size[miss].tolist(), strict=True)])
            new = ~hit[miss]
            self.hash, self.entry = np.insert(self.hash, k[miss[new]], keys[miss[new]]), np.insert(self.entry, k[miss[new]], out[miss[new]])
        return out

    def _literals(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code point starts and ends of the added tokens in texts; off in code points."""
        raw = data.tobytes()
        at = [m.start() for m in self.anywhere.finditer(raw)]
        if not at:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lead = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        edge = lead[off]
        found = [m.span() for i in np.unique(np.searchsorted(edge, at, "right") - 1).tolist() for m in self.literal.finditer(raw, int(edge[i]), int(edge[i + 1]))]
        starts, ends = np.array(found, np.int64).reshape(-1, 2).T
        return np.searchsorted(lead, starts), np.searchsorted(lead, ends)

    def __call__(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(ids, id offsets a text) of a string column."""
        data, off = flat(column)
        cps, off = codepoints(data, off)
        if len(cps) != int(((data & 0xC0) != 0x80).sum()):  # malformed bytes were replaced
            data = np.frombuffer(cps.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        a, b = self._literals(data, off) if self.literal else (off[:0], off[:0])
        if len(a):
            starts = pretoken_starts(cps, np.union1d(off, np.concatenate([a, b])), self.classes)
            k = np.searchsorted(a, starts, "right") - 1
            starts = starts[(k < 0) | (starts == a[k]) | (starts >= b[k])]  # an added token is one piece
        else:
            starts = pretoken_starts(cps, off, self.classes)
        first = np.searchsorted(starts, off)
        starts = np.append(starts, len(cps)) if len(cps) == len(data) else np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))[np.append(starts, len(cps))]
        starts, size = starts[:-1], np.diff(starts)  # in bytes
        if self.known > MEMO:
            self.clear()
        keys, where, inv = np.unique(span_hashes(data, starts, starts + size), return_index=True, return_inverse=True)
        raw, padded = data.tobytes(), np.concatenate([data, np.zeros(8, np.uint8)])
        entry = self._entries(raw, padded, keys, starts[where], size[where])
        odd = np.flatnonzero((size != size[where][inv]) | ~equal_spans(padded, starts, padded, starts[where][inv], np.minimum(size, size[where][inv])))
        if len(odd):  # pre-tokens whose hash another one of the batch has stand for themselves
            entry = np.concatenate([entry, self._learn([raw[a : a + n] for a, n in zip(starts[odd].tolist(), size[odd].tolist(), strict=True)])])
            inv[odd] = len(where) + np.arange(len(odd))
        at, size = self.id_at[entry][inv], self.id_size[entry][inv]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(at - total[:-1], size) + np.arange(total[-1])]
        return ids, total[first]


def pack(tokens: np.ndarray, segments: np.ndarray, loss: np.ndarray, limits: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each item, number of bins): dot-product heuristic under the three limits. Items must fit an empty bin."""
    need = np.stack([tokens, segments, loss], 1).astype(float) / np.array(limits, float)
    order = np.lexsort((np.arange(len(need)), -need.sum(1)))
    need, left = need[order], np.ones(len(need), bool)
    bins = np.full(len(need), -1, np.int64)
    n, head = 0, 0
    whole = np.stack([tokens, segments, loss], 1)[order]
    while head < len(need):
        if not left[head]:
            head += 1
            continue
        room = np.array(limits, np.int64)
        pick = head
        while pick >= 0:
            bins[pick], left[pick] = n, False
            room = room - whole[pick]
            rest = np.flatnonzero(left[head:]) + head
            if not len(rest):
                break
            rest = rest[(whole[rest] <= room).all(1)]
            pick = int(rest[np.argmax(need[rest] @ (room / np.array(limits, float)))]) if len(rest) else -1
        n += 1
    out = np.empty(len(bins), np.int64)
    out[order] = bins
    return out, n


def _marks(text: str, ids: np.ndarray, width: np.ndarray, spans: list) -> np.ndarray:
    """Which of a text's tokens have their first byte in one of the spans (code points)."""
    raw = np.frombuffer(text.encode(), np.uint8)
    edge = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    cover = np.zeros(len(raw) + 1, np.int64)
    for s in spans:
        a, b = (edge[min(max(s[k], 0), len(edge) - 1)] for k in ("start", "end"))
        if a < b:
            cover[a] += 1
            cover[b] -= 1
    own = width[ids]
    return np.cumsum(cover)[np.minimum(np.cumsum(own) - own, len(raw))] > 0


ADDED = ("start", "length", "doc_tokens", "n_loss", "sequence_id", "offset", "ids", "loss_mask")


def _packer(shared, text, capacity, max_segments, max_loss, end_id, extra, loss, ordered):
    def run(batches):
        from pyspark import TaskContext

        home = shared.value  # one object a worker, whatever the task
        if "encoder" not in home:
            home["encoder"] = Encoder(home["content"], encode_special_tokens=False, classes=home["classes"])
        encode = home["encoder"]
        task = TaskContext.get()
        sequence = (task.partitionId() if task else 0) << 40
        names = [*extra, *ADDED]
        full: list[list] = [[] for _ in names]
        items: list[tuple] = []

        def emit():
            nonlocal full
            if full[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(full, [*kinds, *[pa.int64()] * 6, pa.binary(), pa.binary()], strict=True)], names)
            full = [[] for _ in names]

        def add(row):
            for c, v in zip(full, row, strict=True):
                c.append(v)

        def place():
            nonlocal sequence, items
            size, bears = (np.array([x[k] for x in items], np.int64) for k in (1, 2))
            bins, part = np.zeros(len(size), np.int64), np.flatnonzero(size < capacity)
            bins[part], n = pack(size[part], np.ones(len(part), np.int64), bears[part], (capacity, max_segments, max_loss))
            bins[size == capacity] = n + np.arange(len(size) - len(part))
            n += len(size) - len(part)
            if ordered:  # sequences in order of their first items
                _, first = np.unique(bins, return_index=True)
                bins = np.argsort(np.argsort(first))[bins]
            used = np.zeros(n, np.int64)
            for (doc, k, own, start, total, raw, mask), b in zip(items, bins.tolist(), strict=True):
                add([*doc, start, k, total, own, sequence + b, int(used[b]), raw, mask])
                used[b] += k
            sequence += n
            items = []

        kinds = None
        for batch in batches:
            kinds = [batch.schema.field(c).type for c in extra]
            for part in slices(batch, text, 1_500_000):
                ids, off = encode(part.column(text))
                cols = [part.column(c).to_pylist() for c in extra]
                for i in range(part.num_rows):
                    own = np.append(ids[off[i] : off[i + 1]], np.uint32(end_id)).astype("<u4")
                    doc = [c[i] for c in cols]
                    marks = None
                    if loss is not None:
                        marks = np.append(_marks(part.column(text)[i].as_py() or "", own[:-1], encode.width, part.column(loss)[i].as_py() or []), False)
                        before = np.concatenate([[0], np.cumsum(marks)])
                    a = 0
                    while a < len(own):
                        b = min(len(own), a + capacity)
                        if marks is None:
                            b = min(b, a + max_loss + 1)
                            bears, mask = b - a - 1, None
                        else:
                            b = min(b, int(np.searchsorted(before, before[a] + max_loss, "right")) - 1)
                            bears, mask = int(before[b] - before[a]), marks[a:b].astype(np.uint8).tobytes()
                        raw = own[a:b].tobytes()
                        if b - a == capacity and not ordered:
                            add([*doc, a, capacity, len(own), bears, sequence, 0, raw, mask])
                            sequence += 1
                        else:
                            items.append((doc, b - a, bears, a, len(own), raw, mask))
                            if len(items) >= WINDOW_ITEMS:
                                place()
                        a = b
                    if len(full[0]) >= 4096:
                        yield from emit()
        if items:
            place()
        yield from emit()

    return run


def pack_documents(
    docs: DataFrame, tokenizer_path: str, keep: tuple[str, ...] = ("doc_id",), capacity: int = 2048, max_segments: int = 256, max_loss: int = 2048, end_id: int = 1, text: str = "text", loss: str | None = None, order: tuple[str, ...] = ()
) -> DataFrame:
    """One row a piece: the kept columns, start, length, doc_tokens, n_loss, sequence_id, offset, ids (little-endian unsigned 32-bit) and, with `loss`, loss_mask (a byte a token).

    loss: a column of spans, array of (start, end) in code points of the text, whose tokens bear loss.
    order: columns that documents are range-sorted by first; then sequence_id rises with the least place, in that order, of a sequence's pieces.
    """
    no_clash(keep, ADDED)
    if min(capacity, max_segments, max_loss) < 1:
        raise ValueError("limits must be positive")
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast({"content": f.read(), "classes": char_classes()})
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    inner = docs.select(*keep, F.col(text).alias("_text"), *([F.col(loss).alias("_loss")] if loss else []), *[F.col(c).alias(f"_order_{i}") for i, c in enumerate(order)])
    if order:
        by = [F.col(f"_order_{i}") for i in range(len(order))]
        inner = inner.repartitionByRange(*by).sortWithinPartitions(*by).drop(*[f"_order_{i}" for i in range(len(order))])
    run = _packer(shared, "_text", capacity, max_segments, max_loss, end_id, list(keep), "_loss" if loss else None, bool(order))
    added = ", ".join(f"{c} {'binary' if c in ('ids', 'loss_mask') else 'long'}" for c in ADDED)
    return inner.mapInArrow(tidied(run), f"{kinds}, {added}")


def default_tokenizer() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "n_loss")


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return digest(pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer()))
