"""Approximate nearest neighbours by multi-index hashing.

A rotation learned on a bounded sample (principal axes, then iterative
quantisation) turns vectors into binary codes of up to 64 bits. A code is cut into
m substrings of about log2(n) bits, and each has an index: rows stand under the
number and the leading bits of the substring, which name a bucket; a bucket of more
rows than a task should hold is several blocks, and so are the queries that come to it.
Vectors are encoded once. A code within Hamming radius r of
a query's is within r // m bits of it in one of the substrings at least, so a query
goes to just those buckets whose leading bits are within r // m of its own, looks up
the substring values within r // m bits, keeps the codes within r, each in the first
substring that yields it, and reranks their vectors in double precision.

The radius is a query's own. Its tenth distance (k-th, in general) is at most that in
the sample, and at most that among the rows that its first substring's index gives
within one bit. From the sample, and from sampled vectors moved by small steps along
differences of others, a table tells the Hamming distance that `target` of all pairs
at most so far apart keep to. So the radius shrinks as the rows become more. Queries
that still have fewer than k rows get the largest radius, which is every row.

Only vectors of the same length meet; each length has a model. Vectors that are null,
empty, zero, or with null or non-finite components take no part. Rows alike in
vec_id are the same vector for a query's own row, else candidates each; a query id
asks once, with its smallest vector. Ties go to the smaller vec_id. An empty table
gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telemill.llm import _meet
from telemill.llm._text import Tables, tidied

SAMPLE = 8192
#: Leading bits of a substring that name a bucket, at most.
BUCKET_BITS = 16
RESULT = "query_id long, rank int, vec_id long, score double, n_probed long"


def valid(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector can take part, as vec_id and vector."""
    v = F.col(column)
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.filter(fine & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector"))


def learn(sample: np.ndarray, n: int, ids: np.ndarray | None = None, k: int = 10, target: float = 0.985, rounds: int = 30, seed: int = 3) -> dict:
    """Mean, projection to signs, bounds of the substrings for n rows, and the table of radii by distance."""
    mean = sample.mean(0)
    z = sample - mean
    _, _, axes = np.linalg.svd(z, full_matrices=False) if len(sample) > 1 else (0, 0, np.eye(sample.shape[1]))
    bits = min(64, axes.shape[0])
    y = z @ axes[:bits].T
    rng = np.random.default_rng(seed)
    turn = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(y @ turn > 0, 1.0, -1.0).T @ y)
        turn = (u @ w).T
    m = min(bits, max(2, round(bits / max(1.0, np.log2(max(n, 2)))))) if bits > 1 else 1
    model = {"mean": mean, "project": axes[:bits].T @ turn, "bits": bits, "cuts": np.linspace(0, bits, m + 1).round().astype(int), "sample": sample, "ids": ids}
    codes = encode(model, sample)
    far, apart = [], []
    for q in rng.choice(len(sample), min(128, len(sample)), replace=False):
        d = np.sqrt(((sample - sample[q]) ** 2).sum(1))
        d[q] = np.inf
        near = np.argsort(d, kind="stable")[: max(0, min(3 * k, len(sample) - 1))]
        far.append(d[near])
        apart.append(np.bitwise_count(codes[near] ^ codes[q]))
    far, apart = np.concatenate(far), np.concatenate(apart).astype(int)
    steps, radii = [], []
    for part in (0.02, 0.05, 0.1, 0.25, 0.5, 0.75, 1.0):
        if len(far):
            steps.append(np.quantile(far, part))
            radii.append(np.quantile(apart[far <= steps[-1]], target))
    least = steps[0] if steps else 0.0
    for shrink in range(1, 13):  # pairs nearer than any of the sample
        if least > 0 and len(sample) > 2:
            a, b, c = (sample[rng.integers(0, len(sample), 512)] for _ in range(3))
            size = np.sqrt(((b - c) ** 2).sum(1))
            a, way = a[size > 0], ((b - c)[size > 0].T / size[size > 0]).T
            if len(a):
                step = least * 0.7**shrink
                steps.append(step)
                radii.append(np.quantile(np.bitwise_count(encode(model, a) ^ encode(model, a + step * way)), target))
    order = np.argsort(steps)
    model["steps"], model["radii"] = np.array(steps)[order], np.maximum.accumulate(np.array(radii)[order]) if steps else np.array(radii)
    return model


def radius_of(model: dict, distance: np.ndarray) -> np.ndarray:
    """The Hamming radius that the target share of vectors at most so far away keeps to."""
    steps, radii = model["steps"], model["radii"]
    if not len(steps):
        return np.full(len(distance), model["bits"])
    at = np.searchsorted(steps, distance)
    return np.where(at < len(steps), np.ceil(radii[np.minimum(at, len(steps) - 1)]), model["bits"]).astype(int)


def encode(model: dict, x: np.ndarray) -> np.ndarray:
    signs = ((x - model["mean"]) @ model["project"]) > 0
    weights = np.uint64(1) << np.arange(model["bits"], dtype=np.uint64)
    return (signs * weights).sum(1, dtype=np.uint64)


def substring(model: dict, codes: np.ndarray, j: int) -> np.ndarray:
    a, b = model["cuts"][j : j + 2]
    return (codes >> np.uint64(a)) & np.uint64((1 << int(b - a)) - 1)


def bucket(model: dict, codes: np.ndarray, j: int, lead: int) -> np.ndarray:
    """The leading bits of a substring."""
    length = int(model["cuts"][j + 1] - model["cuts"][j])
    return (substring(model, codes, j) >> np.uint64(max(0, length - lead))).astype(np.int64)


def masks(length: int, most: int) -> np.ndarray:
    """All values of `length` bits with at most `most` of them set."""
    return np.array([sum(1 << i for i in c) for r in range(min(most, length) + 1) for c in combinations(range(length), r)], np.uint64)


def _count(length: int, most: int) -> int:
    total, term = 0, 1
    for r in range(min(most, length) + 1):
        total += term
        term = term * (length - r) // (r + 1)
    return total


class Block:
    """Rows of one bucket in order of one substring's value; looks up values near a query's."""

    def __init__(self, model: dict, codes: np.ndarray, j: int):
        self.model, self.codes, self.j = model, codes, j
        s = substring(model, codes, j)
        self.order = np.argsort(s, kind="stable")
        self.values, first = np.unique(s[self.order], return_index=True)
        self.first = np.append(first, len(s))
        self.length = int(model["cuts"][j + 1] - model["cuts"][j])
        self.known: dict[int, np.ndarray] = {}

    def within(self, code: np.uint64, radius: int, most: int) -> np.ndarray:
        """Rows whose substring is within `most` bits, whose code is within the radius, and that no earlier substring's index yields."""
        own = substring(self.model, np.array([code]), self.j)[0]
        if _count(self.length, most) < len(self.values):  # probe them, else compare
            if most not in self.known:
                self.known[most] = masks(self.length, most)
            want = self.known[most] ^ own
            at = np.minimum(np.searchsorted(self.values, want), len(self.values) - 1)
            hit = at[self.values[at] == want]
        else:
            hit = np.flatnonzero(np.bitwise_count(self.values ^ own) <= most)
        size = self.first[hit + 1] - self.first[hit]
        rows = self.order[np.repeat(self.first[hit] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        apart = self.codes[rows] ^ code
        fine = np.bitwise_count(apart) <= radius
        for i in range(self.j):
            fine &= np.bitwise_count(substring(self.model, apart, i)) > most
        return rows[fine]


def _vectors(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def _best(ids: np.ndarray, x: np.ndarray, rows: np.ndarray, vector: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest rows and their distances, ties to the smaller id."""
    d = np.sqrt(((x[rows] - vector) ** 2).sum(1))
    if len(d) > k:
        edge = np.partition(d, k - 1)[k - 1]
        rows, d = rows[d <= edge], d[d <= edge]
    best = np.lexsort((ids[rows], d))[:k]
    return rows[best], d[best]


def _one_length(vectors: DataFrame, queries: DataFrame, width: int, k: int, tables: Tables) -> DataFrame:
    spark = vectors.sparkSession
    kind = vectors.schema["vector"].dataType.simpleString()
    n = vectors.count()
    taken = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(SAMPLE).toArrow()
    model = learn(_vectors(taken.column("vector").combine_chunks(), width), n, taken.column("vec_id").to_numpy(), k)
    shared = spark.sparkContext.broadcast(model)
    m, bits = len(model["cuts"]) - 1, model["bits"]
    lead = max(0, min(BUCKET_BITS, int(np.ceil(np.log2(max(1, n / _meet.BLOCK_ROWS))))))
    first = int(min(lead, model["cuts"][1] - model["cuts"][0]))

    def coded(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(encode(shared.value, _vectors(batch.column("vector"), width)).view(np.int64))], ["vec_id", "vector", "code"])

    rows = tables.keep(vectors.mapInArrow(tidied(coded), f"vec_id long, vector {kind}, code long"))

    def index(numbers) -> DataFrame:
        """A row of each substring under its number and leading bits (see `bucket`); there are m * 2^BUCKET_BITS of these at most."""
        places = []
        for j in numbers:
            a, b = (int(x) for x in model["cuts"][j : j + 2])
            own = F.shiftrightunsigned("code", a).bitwiseAND(F.lit((1 << b - a) - 1 if b - a < 64 else -1))
            places.append(F.struct(F.lit(j).cast("int").alias("j"), F.shiftrightunsigned(own, max(0, b - a - lead)).cast("long").alias("g")))
        return rows.select("vec_id", "vector", "code", F.inline(F.array(*places)))

    def bounded(batches):
        """Queries with their code and their k-th distance in the sample."""
        sample, ids = shared.value["sample"], shared.value["ids"]
        for batch in batches:
            if not batch.num_rows:
                continue
            x, own = _vectors(batch.column("vector"), width), batch.column("vec_id").to_numpy()
            far = np.full(len(x), np.inf)
            for i in range(len(x)):
                d = np.sqrt(((sample[ids != own[i]] - x[i]) ** 2).sum(1))
                if len(d) >= k:
                    far[i] = np.partition(d, k - 1)[k - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(encode(shared.value, x).view(np.int64)), pa.array(far)], ["vec_id", "vector", "code", "bound"])

    def probes(numbers, whole: bool):
        """Queries to the buckets within reach: one bit of the substring in the first round, then as the radius by their bound asks, or all."""

        def run(batches):
            for batch in batches:
                codes = batch.column("code").to_numpy().view(np.uint64)
                bound = batch.column("bound").to_numpy()
                early = not whole and len(numbers) < m
                reach = np.full(len(codes), bits) if whole or early else radius_of(shared.value, bound)
                most = np.ones(len(codes), int) if early else np.full(len(codes), bits) if whole else reach // m
                for j in numbers:
                    own = bucket(shared.value, codes, j, lead)
                    every = np.arange(1 << min(lead, int(shared.value["cuts"][j + 1] - shared.value["cuts"][j])))
                    for i in range(len(codes)):
                        to = every[np.bitwise_count(every ^ own[i]) <= most[i]]
                        at = pa.array(np.full(len(to), i))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(to), j, np.int32)), pa.array(to), *[c.take(at) for c in batch.columns], pa.array(np.full(len(to), reach[i], np.int32)), pa.array(np.full(len(to), most[i], np.int32))], ["j", "g", *batch.schema.names, "radius", "most"])

        return run

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            ids, x = left.column("vec_id").to_numpy(), _vectors(left.column("vector").combine_chunks(), width)
            at = Block(shared.value, left.column("code").to_numpy().view(np.uint64), left.column("j")[0].as_py())
            asked = _vectors(right.column("vector").combine_chunks(), width)
            codes = right.column("code").to_numpy().view(np.uint64)
            for query, code, radius, most, vector in zip(right.column("vec_id").to_pylist(), codes, right.column("radius").to_pylist(), right.column("most").to_pylist(), asked, strict=True):
                found = at.within(code, radius, most)
                found = found[ids[found] != query]
                best, d = _best(ids, x, found, vector, k)
                out[0] += [query] * len(best)
                out[1] += ids[best].tolist()
                out[2] += d.tolist()
                out[3] += [len(found)] + [0] * (len(best) - 1) if len(best) else []
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64()), "probed": pa.array(out[3], pa.int64())})

    def round_of(asked: DataFrame, numbers, whole: bool = False) -> DataFrame:
        to = tables.keep(asked.mapInArrow(tidied(probes(numbers, whole)), f"j int, g long, vec_id long, vector {kind}, code long, bound double, radius int, most int"))
        found = _meet.meet(index(numbers), to, ("j", "g"), block, "query_id long, vec_id long, score double, probed long", tables)
        total = Window.partitionBy("query_id")
        best = found.withColumn("rank", F.row_number().over(total.orderBy("score", "vec_id"))).withColumn("n_probed", F.sum("probed").over(total))
        return tables.keep(best.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "n_probed"))

    once = queries.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    asked = tables.keep(once.mapInArrow(tidied(bounded), f"vec_id long, vector {kind}, code long, bound double"))
    if first:  # else the first round would see what the next one does
        tenth = round_of(asked, [0]).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("_near"))
        asked = tables.keep(asked.join(tenth, "vec_id", "left").withColumn("bound", F.least("bound", "_near")).drop("_near"))
    got = round_of(asked, range(m))
    full = got.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    rest = tables.keep(asked.join(full, "vec_id", "left_anti"))
    if rest.isEmpty():
        return got
    last = round_of(rest, [0], whole=True)  # one index holds every row
    return got.join(rest.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(last).select("query_id", "rank", "vec_id", "score", "n_probed")


def search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score, n_probed) from vectors and queries (vec_id, vector) as `valid` gives them; score is the Euclidean distance, n_probed the number of rows reranked for the query."""
    tables, out = Tables(vectors.sparkSession), None
    for (width,) in sorted(queries.select(F.size("vector")).distinct().collect()):
        same = F.size("vector") == width
        got = _one_length(vectors.filter(same), queries.filter(same), width, k, tables)
        out = got if out is None else out.unionByName(got)
    return vectors.sparkSession.createDataFrame([], RESULT) if out is None else out


def op5_nearest(spark, sf_dir: str) -> DataFrame:
    vectors = valid(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return search(vectors, vectors.filter(F.col("vec_id") % 100 == 0))
