"""Exact top-k search by inner product over a pivot-distance index.

Vectors are lifted onto a sphere: with M the greatest length of all vectors, x gets a
further component sqrt(M^2 - |x|^2), and a query q gets 0, so that the highest inner
product is the least distance: d(q, x)^2 = |q|^2 + M^2 - 2 q.x. Pivots are centres of a
bounded sample; a row is keyed by its nearest pivot and its distance to it, and the
distances of a pivot are cut into annuli (quantiles of the sample), each with the exact
least and greatest distance of its rows. By the triangle inequality a row of an annulus
[a, b] is no nearer to q than max(0, d(q, p) - b, a - d(q, p)), which bounds its score; so does
q.p + |q| b, as the row is within b of p.

A query sorts all annuli by their bound and goes outwards in rounds: first those that
hold k + 1 rows, then more, as many as hold EXPAND times the rows of the round before.
It stops where the bound falls below its k-th score so far; the bounds are sorted, so
nothing behind can be better. Rows and queries of an annulus meet in blocks and chunks.

What is collected: the pivots' sample (SAMPLE rows) and the directory of annuli (PIVOTS *
ANNULI rows at most). Ties go to the smaller vec_id. A query is no candidate of its own
id; rows that repeat an id are candidates each, and such an id asks once, with its
smallest vector. Only vectors of equal length meet. Null vectors, those with null or
non-finite components and those without components are left out by `scaled`; an empty
table gives no rows. Sums must fit a long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telemill.llm._meet import ASK_ROWS, best, matrix, meet, products, scaled
from telemill.llm._text import Tables, tidied

SAMPLE = 8192
PIVOTS, ANNULI = 256, 64
#: Rows of an annulus, about, while there are fewer than PIVOTS * ANNULI of them.
ANNULUS_ROWS = 512
#: Rows that the second round may look at, and the factor for each further round.
SECOND_ROWS, EXPAND = 4096, 16
NONE = -(1 << 63)
RESULT = "query_id long, rank int, vec_id long, score long"
#: Share of |q|^2 + M^2 that covers rounding of the bounds.
SLACK = 1e-6


def lifted(x: np.ndarray, square: float) -> np.ndarray:
    x = x.astype(np.float64)
    return np.concatenate([x, np.sqrt(np.maximum(0, square - (x * x).sum(1)))[:, None]], 1)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * x @ pivots.T))


def learn(sample: np.ndarray, n: int, square: float, rounds: int = 8, seed: int = 5) -> dict:
    """Pivots, and edges of their annuli, for n rows with greatest squared length `square`."""
    x, rng = np.unique(lifted(sample, square), axis=0), np.random.default_rng(seed)
    count = min(PIVOTS, len(x), max(1, round(np.sqrt(n) / 4)))
    pivots = x[np.sort(rng.choice(len(x), count, replace=False))]
    for _ in range(rounds):
        own = distances(x, pivots).argmin(1)
        size = np.bincount(own, minlength=count)
        total = np.stack([np.bincount(own, w, count) for w in x.T], 1)
        pivots = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], pivots)
    d = distances(x, pivots)
    own = d.argmin(1)
    annuli = min(ANNULI, max(1, round(n / (count * ANNULUS_ROWS))))
    cuts = np.arange(1, annuli) / annuli
    edges = np.stack([np.quantile(d[own == p, p], cuts) if (own == p).any() else np.zeros(annuli - 1) for p in range(count)])
    return {"square": square, "pivots": pivots, "edges": edges, "annuli": annuli}


def keys(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cell (pivot and annulus) and the distance to the pivot of each vector."""
    d = distances(lifted(x, model["square"]), model["pivots"])
    pivot = d.argmin(1)
    r = d[np.arange(len(d)), pivot]
    return pivot * model["annuli"] + (r[:, None] > model["edges"][pivot]).sum(1), r


def bounds(model: dict, directory: dict, q: np.ndarray) -> np.ndarray:
    """The highest score that a row of each cell can have with each query, rounding included."""
    x = q.astype(np.float64)
    square = (x * x).sum(1)
    pivot = directory["cell"] // model["annuli"]
    d = distances(np.concatenate([x, np.zeros((len(x), 1))], 1), model["pivots"])[:, pivot]
    gap = np.maximum(0, np.maximum(d - directory["far"], directory["near"] - d))
    both = square[:, None] + model["square"]
    ball = (x @ model["pivots"][:, :-1].T)[:, pivot] + np.sqrt(square)[:, None] * directory["far"]
    return np.minimum((both - gap * gap) / 2, ball) + SLACK * both


def ring(model: dict, directory: dict, q: np.ndarray, low: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, cell) of this round: those in the order of bounds that have from `begin` to `end` rows before them, while the bound reaches the query's k-th score."""
    bound = bounds(model, directory, q)
    order = np.argsort(-bound, 1, kind="stable")
    rows = directory["rows"][order]
    before = np.cumsum(rows, 1) - rows
    at, place = np.nonzero((before >= begin) & (before < end) & (np.take_along_axis(bound, order, 1) >= low[:, None]))
    return at, order[at, place]


def _one_length(vectors: DataFrame, queries: DataFrame, width: int, k: int, tables: Tables) -> tuple[DataFrame, list[DataFrame]]:
    spark = vectors.sparkSession
    n, square = vectors.agg(F.count(F.lit(1)), F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x))).first()
    taken = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(SAMPLE).toArrow()
    model = learn(matrix(taken.column("vector"), width), n, square * (1 + 1e-12))
    shared = spark.sparkContext.broadcast(model)

    def keyed(batches):
        for batch in batches:
            cell, r = keys(shared.value, matrix(batch.column("vector"), width))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(r)], ["vec_id", "vector", "cell", "r"])

    index = tables.keep(vectors.mapInArrow(tidied(keyed), "vec_id long, vector array<long>, cell int, r double"))
    listed = index.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.min("r").alias("near"), F.max("r").alias("far")).orderBy("cell").toArrow()
    directory = spark.sparkContext.broadcast({c: listed.column(c).to_numpy() for c in listed.column_names})

    def probes(begin, end):
        def run(batches):
            for batch in batches:
                for a in range(0, batch.num_rows, ASK_ROWS):
                    part = batch.slice(a, ASK_ROWS)
                    at, cell = ring(shared.value, directory.value, matrix(part.column("vector"), width), part.column("low").to_numpy(), begin, end)
                    yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in part.columns), *(pa.array(directory.value[c][cell]) for c in ("cell", "rows"))], ["query_id", "vector", "low", "cell", "rows"])

        return run

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            ids, x = left.column("vec_id").to_numpy(), matrix(left.column("vector"), width)
            asked, own, low = matrix(right.column("vector"), width), right.column("query_id").to_numpy(), right.column("low").to_numpy()
            for a in range(0, len(own), ASK_ROWS):
                for i, s in enumerate(products(asked[a : a + ASK_ROWS], x), a):
                    at = np.flatnonzero((s >= low[i]) & (ids != own[i]))
                    at = at[best(s[at], ids[at], k)]
                    out[0].append(np.full(len(at), own[i]))
                    out[1].append(ids[at])
                    out[2].append(s[at])
        return pa.table({c: np.concatenate(x) if x else np.zeros(0, np.int64) for c, x in zip(("query_id", "vec_id", "score"), out, strict=True)})

    asked = tables.keep(queries.groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vector").alias("vector")).withColumn("low", F.lit(NONE).cast("long")))
    got, seen, begin, end = None, [], 0, k + 1
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    while begin < n:
        to = tables.keep(asked.mapInArrow(tidied(probes(begin, end)), "query_id long, vector array<long>, low long, cell int, rows long"))
        if to.isEmpty():
            break
        seen.append(to.select("query_id", "rows"))
        found = meet(index.select("vec_id", "vector", "cell"), to.select("query_id", "vector", "low", "cell"), ("cell",), scored, "query_id long, vec_id long, score long", tables)
        found = found if got is None else found.unionByName(got.drop("rank"))
        got = tables.keep(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))
        kth = got.filter(F.col("rank") == k).select("query_id", F.col("score").alias("_k"))
        asked = tables.keep(asked.join(kth, "query_id", "left").select("query_id", "vector", F.coalesce("_k", "low").alias("low")))
        begin, end = end, max(SECOND_ROWS, end * EXPAND)
    return (got if got is not None else spark.createDataFrame([], RESULT)).select("query_id", "rank", "vec_id", "score"), seen


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, count: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score) from integer vectors and queries (vec_id, vector) as `scaled` gives them; count adds n_scored, the rows that were scored for the query."""
    spark, seen = vectors.sparkSession, []
    tables, out = Tables(spark), None
    for (width,) in sorted(queries.select(F.size("vector")).distinct().collect()):
        same = F.size("vector") == width
        got, more = _one_length(vectors.filter(same), queries.filter(same), width, k, tables)
        seen += more
        out = got if out is None else out.unionByName(got)
    if out is None:
        out = spark.createDataFrame([], RESULT)
    if not count:
        return out
    rows = spark.createDataFrame([], "query_id long, rows long")
    for x in seen:
        rows = rows.unionByName(x)
    return out.join(rows.groupBy("query_id").agg(F.sum("rows").alias("n_scored")), "query_id", "left")


def op12_top_k(spark, sf_dir: str) -> DataFrame:
    vectors = scaled(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 1024)
    return top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


def vectors_sql(factor: int, more: str = "") -> str:
    return f"""v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({factor} * CAST(x AS DOUBLE)) AS BIGINT)) AS v{more}
  FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""


PRODUCT_SQL = "CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT)"

OP12_SQL = f"""WITH {vectors_sql(1024)},
q AS (SELECT vec_id AS query_id, min(v) AS v FROM v WHERE vec_id % 100 = 0 GROUP BY 1),
s AS (SELECT a.query_id, b.vec_id, {PRODUCT_SQL} AS score FROM q a JOIN v b ON b.vec_id <> a.query_id AND len(a.v) = len(b.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 10"""
