"""Vectorised text primitives over Arrow string columns, and session helpers.

Texts stay as one flat byte (or code point) array a batch with document
offsets; no Python object is made per word or character.
"""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Most bytes of text that one vectorised step handles, unless one text is longer.
SLICE_BYTES = 2_000_000


def shared_folder(spark) -> str:
    """The folder that the session names in spark.checkpoint.dir. Where none is named: a temporary one on a local master, else one in the warehouse."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        named = tempfile.mkdtemp(prefix="telemill-shared-") if sc.master.startswith("local") else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/telemill-shared"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


class Tables:
    """Intermediate results as Parquet tables in the shared folder, removed one by one or when the session ends."""

    def __init__(self, spark):
        self.spark, self.number = spark, 0
        self.folder = f"{shared_folder(spark)}/telemill-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.files = self.path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.files.deleteOnExit(self.path(self.folder))

    def keep(self, df, **options):
        """Writes a frame, with options of the format, and reads it back, as a new one without lineage."""
        self.number += 1
        path = f"{self.folder}/{self.number}"
        df.write.options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._telemill_path = path
        return out

    def drop(self, *frames) -> None:
        """Removes tables that nothing will read again."""
        for df in frames:
            self.files.delete(self.path(df._telemill_path), True)


def tidied(run):
    """A mapper that in the end gives freed memory back to the system: workers live on between stages, beside the next ones."""

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # a function of the GNU library
        if trim is not None:
            trim(0)

    return wrapped


def no_clash(keep, added) -> None:
    """Columns that a caller keeps must not have the names of those an operator adds."""
    both = sorted(set(keep) & set(added))
    if both:
        raise ValueError(f"columns to keep clash with added ones: {both}")


def strings(column) -> pa.Array:
    """A plain string array; null becomes the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    return column.fill_null("") if column.null_count else column


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, offsets from 0."""
    a = strings(column)
    if len(a) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    data = np.frombuffer(a.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Row slices of a batch of about `limit` bytes of the column each, or elements of lists; a longer text stands alone."""
    a = batch.column(column)
    a = a if pa.types.is_list(a.type) else strings(a)
    if len(a) == 0:
        return
    off = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    at = 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def codepoints(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets) of flat UTF-8; malformed bytes become U+FFFD."""
    try:
        cps = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        return cps, lead[off]
    except UnicodeError:
        raw = data.tobytes()
        parts = [np.frombuffer(raw[a:b].decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for a, b in zip(off[:-1], off[1:], strict=True)]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def _is_word() -> np.ndarray:
    t = np.ones(256, bool)
    t[[0x20, *range(0x09, 0x0E)]] = False
    return t


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words `[^\\x20\\x09-\\x0D]+`, and word offsets a document."""
    if len(data) == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    w = _is_word()[data]
    before = np.empty_like(w)
    before[0], before[1:] = False, w[:-1]
    after = np.empty_like(w)
    after[-1], after[:-1] = False, w[1:]
    full = off[:-1][np.diff(off) > 0]
    before[full] = False
    after[full[1:] - 1] = False
    starts = np.flatnonzero(w & ~before)
    ends = np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
#: Longer spans are hashed one by one, by a digest.
LONG_SPAN = 4096


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: a chain of finalisers over words of 8 bytes. Spans of up to 8 bytes and equal length never collide."""
    if len(starts) == 0:
        return np.empty(0, U64)
    size = ends - starts
    eight = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))
    with np.errstate(over="ignore"):
        h = mix((eight[starts] & _MASKS[np.minimum(size, 8)]) ^ (size.astype(U64) * U64(0xD6E8FEB86659FD93)))
        more, at = np.flatnonzero((size > 8) & (size <= LONG_SPAN)), 8
        while len(more):
            h[more] = mix(h[more] * U64(0x9E3779B97F4A7C15) + (eight[starts[more] + at] & _MASKS[np.minimum(size[more] - at, 8)]))
            at += 8
            more = more[size[more] > at]
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def lower_ascii() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


class Parts:
    """A table too large to hold, as broadcasts of bounded size; a task reads each from its local file and lets it go."""

    def __init__(self, df, keys: tuple[str, ...], most: int, arrange=dict):
        """df: a stored table, as it is read once a part; rows of a key come to one part, and a part has about `most` rows. arrange: what is made of a part's columns."""
        from pyspark.sql import functions as F

        n = max(1, -(-df.count() // most))
        slot = F.pmod(F.xxhash64(*keys, F.lit("part")), F.lit(n))
        self.shared = []
        for i in range(n):
            rows = df.filter(slot == i).toArrow()
            self.shared.append(df.sparkSession.sparkContext.broadcast(arrange({c: rows.column(c).to_numpy() for c in rows.column_names})))

    def __iter__(self):
        for b in self.shared:
            yield b.value
            b.__dict__.pop("_value", None)
