"""Hard negatives by a dual-tree search.

Two binary trees, one over the candidates and one over the anchors, split the vectors of
a bounded sample at the median along the line between two far points; a node has a centre
and, from all rows, the greatest distance of its rows to it. So the inner products of an
anchor node A and a candidate node C lie in

    cA.cC -+ (|cA| rC + |cC| rA + rA rC).

A node pair is left out, with all its anchors and candidates, if that interval misses the
scores that its anchors still look for; else the wider node is opened, down to pairs of
leaves. Anchors of surviving pairs, unless their own interval with the leaf misses their
scores, meet the leaf's rows, which are scored exactly.

Positives first: the `positives` rows of an anchor's label with the highest scores. One
leaf, the most promising, gives each anchor a k-th score, below which nothing is looked
for; label buckets (a hash of the label) have radii of their own, so nodes without a
bucket's rows are left out. Then negatives: for each positive of score s, the first
`negatives` rows of other labels with lower * s <= 100 * score <= upper * s; again one
leaf gives a first bound for each of these windows, and the node pairs are held against
the least of those bounds and the highest end of a window.

What is collected: samples (SAMPLE rows), and radii and bounds of nodes (BUCKETS times the
leaves, which are at most 2^CANDIDATE_DEPTH and 2^ANCHOR_DEPTH). Leaves of more rows than a
group holds meet in blocks and chunks.

Rows with a null label are left out, like those that `scaled` leaves out. Ties go to the
smaller vec_id. Rows with an anchor's id are not its candidates; rows that repeat an id
are candidates each, and such an anchor asks once, with its smallest label and vector.
Only vectors of equal length meet. An empty table gives no rows. Sums must fit a long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telemill.llm._meet import ASK_ROWS, best, matrix, meet, products, scaled
from telemill.llm._text import Tables, tidied
from telemill.llm.annuli import PRODUCT_SQL, vectors_sql

SAMPLE = 8192
#: Rows of a leaf, about, while the tree is not at its greatest depth.
LEAF_ROWS, LEAF_ANCHORS = 1024, 64
CANDIDATE_DEPTH, ANCHOR_DEPTH = 10, 8
BUCKETS = 64
LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Share of a product of lengths that covers rounding of the intervals.
SLACK = 1e-9
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def grow(sample: np.ndarray, depth: int) -> dict:
    """A complete binary tree: direction and threshold of inner nodes, centre of all; node i has the children 2i + 1 and 2i + 2."""
    width, inner = sample.shape[1], (1 << depth) - 1
    tree = {"depth": depth, "way": np.zeros((inner, width)), "cut": np.zeros(inner), "centre": np.zeros((2 * inner + 1, width))}
    rows = {0: sample.astype(np.float64)}
    for i in range(2 * inner + 1):
        x = rows.pop(i)
        tree["centre"][i] = x.mean(0) if len(x) else tree["centre"][max(0, (i - 1) // 2)]
        if i < inner:
            if len(x):
                one = x[((x - tree["centre"][i]) ** 2).sum(1).argmax()]
                tree["way"][i] = x[((x - one) ** 2).sum(1).argmax()] - one
                tree["cut"][i] = np.median(x @ tree["way"][i])
            right = x @ tree["way"][i] > tree["cut"][i]
            rows[2 * i + 1], rows[2 * i + 2] = x[~right], x[right]
    return tree


def route(tree: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The leaf of each vector, counted from 0, and the distance to its centre."""
    x, node = x.astype(np.float64), np.zeros(len(x), np.int64)
    for _ in range(tree["depth"]):
        node = 2 * node + 1 + (np.einsum("ij,ij->i", x, tree["way"][node]) > tree["cut"][node])
    return node - ((1 << tree["depth"]) - 1), np.sqrt(((x - tree["centre"][node]) ** 2).sum(1))


def upward(tree: dict, leaves: np.ndarray, merge) -> np.ndarray:
    """Values of all nodes from those of the leaves (last axis): merge(parent, child, child's value) over both children, the greater one."""
    inner = (1 << tree["depth"]) - 1
    out = np.concatenate([np.full((*leaves.shape[:-1], inner), -np.inf), leaves], -1)
    for i in reversed(range(inner)):
        out[..., i] = np.maximum(*(merge(i, c, out[..., c]) for c in (2 * i + 1, 2 * i + 2)))
    return out


def radii(tree: dict, leaves: np.ndarray) -> np.ndarray:
    """The radius of all nodes about their centres, -inf for those without rows."""
    return upward(tree, leaves, lambda i, c, r: r + np.sqrt(((tree["centre"][i] - tree["centre"][c]) ** 2).sum()))


def interval(a: np.ndarray, ra: np.ndarray, c: np.ndarray, rc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of balls, row by row, rounding included."""
    na, nc = np.sqrt((a * a).sum(-1)), np.sqrt((c * c).sum(-1))
    mid, half = np.einsum("...j,...j->...", a, c), na * rc + nc * ra + ra * rc
    half = half + SLACK * (na + ra) * (nc + rc)
    return mid - half, mid + half


def leaf_pairs(at: dict, ct: dict, ra: np.ndarray, rc: np.ndarray, low: np.ndarray, high: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor leaf, candidate leaf) below an anchor node whose interval meets the scores that the anchor leaf looks for; low and high are those of all anchor nodes."""
    ia, ic = (1 << at["depth"]) - 1, (1 << ct["depth"]) - 1
    a, c, done = np.array([start]), np.array([0]), [np.zeros((2, 0), np.int64)]
    while len(a):
        fine = np.isfinite(ra[a]) & np.isfinite(rc[c])
        a, c = a[fine], c[fine]
        lo, hi = interval(at["centre"][a], ra[a], ct["centre"][c], rc[c])
        fine = (hi >= low[a]) & (lo <= high[a])
        a, c = a[fine], c[fine]
        last = (a >= ia) & (c >= ic)
        done.append(np.stack([a[last] - ia, c[last] - ic]))
        a, c = a[~last], c[~last]
        first = (a < ia) & ((c >= ic) | (ra[a] >= rc[c]))
        a, c = np.concatenate([2 * a[first] + 1, 2 * a[first] + 2, a[~first], a[~first]]), np.concatenate([c[first], c[first], 2 * c[~first] + 1, 2 * c[~first] + 2])
    return tuple(np.concatenate(done, 1))


class _Search:
    """The steps of one search over vectors of one length; both trees and the radii are broadcast."""

    def __init__(self, rows: DataFrame, anchors: DataFrame, width: int, tables: Tables):
        self.spark, self.width, self.tables = rows.sparkSession, width, tables
        bucket = F.pmod(F.xxhash64("label"), F.lit(BUCKETS)).cast("int").alias("bucket")
        self.label = rows.schema["label"].dataType.simpleString()

        def planted(df, depth, per):
            n = df.count()
            taken = df.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(SAMPLE).toArrow()
            return grow(matrix(taken.column("vector"), width), min(depth, max(0, int(np.ceil(np.log2(max(1, n / per)))))))

        def placed(df, tree):
            shared = self.spark.sparkContext.broadcast(tree)

            def run(batches):
                for batch in batches:
                    leaf, far = route(shared.value, matrix(batch.column("vector"), width))
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf.astype(np.int32)), pa.array(far)], ["vec_id", "label", "vector", "bucket", "leaf", "far"])

            return tables.keep(df.select("vec_id", "label", "vector", bucket).mapInArrow(tidied(run), f"vec_id long, label {self.label}, vector array<long>, bucket int, leaf int, far double"))

        once = anchors.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("x")).select("vec_id", "x.label", "x.vector")
        self.ct, self.at = planted(rows, CANDIDATE_DEPTH, LEAF_ROWS), planted(once, ANCHOR_DEPTH, LEAF_ANCHORS)
        self.rows = placed(rows, self.ct)
        self.anchors = placed(once, self.at).withColumnRenamed("vec_id", "anchor_id")
        own = self.leaves(self.rows, self.ct, F.max("far"))
        self.rc = {"bucket": radii(self.ct, own), "all": radii(self.ct, own.max(0, keepdims=True))}
        self.trees = self.spark.sparkContext.broadcast((self.at, self.ct, self.rc))

    def leaves(self, df: DataFrame, tree: dict, value) -> np.ndarray:
        """An aggregate by bucket and leaf, -inf where there are no rows."""
        got = df.groupBy("bucket", "leaf").agg(value.cast("double").alias("x")).toArrow()
        out = np.full((BUCKETS, 1 << tree["depth"]), -np.inf)
        out[got.column("bucket").to_numpy(), got.column("leaf").to_numpy()] = got.column("x").to_numpy()
        return out

    def promising(self, asked: DataFrame, by: str) -> DataFrame:
        """Each anchor with one leaf: that with the greatest product of its centre, among those that hold rows (of the bucket)."""
        trees, names = self.trees, asked.columns

        def run(batches):
            _, ct, rc = trees.value
            inner = (1 << ct["depth"]) - 1
            for batch in batches:
                x, own = matrix(batch.column("vector"), self_width).astype(np.float64), batch.column("bucket").to_numpy()
                held = np.isfinite(rc[by][own if by == "bucket" else np.zeros(len(own), int), inner:])
                leaf = np.where(held, x @ ct["centre"][inner:].T, -np.inf).argmax(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf.astype(np.int32))], [*names, "cell"])

        self_width = self.width
        return self.tables.keep(asked.mapInArrow(tidied(run), f"{_schema(asked)}, cell int"))

    def surviving(self, asked: DataFrame, by: str) -> DataFrame:
        """Anchors (with low and high, the scores they look for) with all leaves that may hold such scores."""
        trees, names, width = self.trees, asked.columns, self.width
        ra = radii(self.at, self.leaves(asked, self.at, F.max("far")))
        low = -upward(self.at, self.leaves(asked, self.at, -F.min(F.col("low").cast("double"))), lambda i, c, x: x)
        high = upward(self.at, self.leaves(asked, self.at, F.max("high")), lambda i, c, x: x)
        held = self.spark.sparkContext.broadcast((ra, low, high))
        top = min(4, self.at["depth"])
        starts = [(b, i) for b in range(BUCKETS) for i in range((1 << top) - 1, (2 << top) - 1) if np.isfinite(ra[b, i])]
        groups = self.spark.createDataFrame(starts, "bucket int, node int").repartition(max(1, min(len(starts), 64)), "bucket", "node")

        def walk(batches):
            at, ct, rc = trees.value
            ra, low, high = held.value
            for batch in batches:
                for b, node in zip(batch.column("bucket").to_pylist(), batch.column("node").to_pylist(), strict=True):
                    a, c = leaf_pairs(at, ct, ra[b], rc[by][b if by == "bucket" else 0], low[b], high[b], node)
                    order = np.lexsort((c, a))
                    leaf, size = np.unique(a, return_counts=True)
                    lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), pa.array(c[order].astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(leaf), b, np.int32)), pa.array(leaf.astype(np.int32)), lists], ["bucket", "leaf", "cells"])

        def opened(batches):
            _, ct, rc = trees.value
            inner = (1 << ct["depth"]) - 1
            for batch in batches:
                for k in range(0, batch.num_rows, ASK_ROWS):
                    part = batch.slice(k, ASK_ROWS)
                    lists = part.column("cells")
                    at, cell = lists.value_parent_indices().to_numpy(), lists.flatten().to_numpy()
                    x, own = matrix(part.column("vector"), width).astype(np.float64)[at], part.column("bucket").to_numpy()[at]
                    lo, hi = interval(x, np.zeros(len(x)), ct["centre"][inner + cell], rc[by][own if by == "bucket" else 0, inner + cell])
                    fine = (hi >= part.column("low").to_numpy()[at]) & (lo <= part.column("high").to_numpy()[at])
                    yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(at[fine])) for c in names), pa.array(cell[fine])], [*names, "cell"])

        pairs = groups.mapInArrow(tidied(walk), "bucket int, leaf int, cells array<int>")
        return self.tables.keep(asked.join(pairs, ["bucket", "leaf"]).select(*names, "cells").mapInArrow(tidied(opened), f"{_schema(asked)}, cell int"))

    def positives(self, asked: DataFrame, k: int) -> DataFrame:
        """(anchor_id, place, positive_id, positive_score) among the rows of the leaves that the anchors go to."""
        width = self.width

        def scored(left: pa.Table, right: pa.Table) -> pa.Table:
            out: list[list] = [[], [], []]
            if left.num_rows and right.num_rows:
                ids, x, kinds = left.column("vec_id").to_numpy(), matrix(left.column("vector"), width), left.column("label").to_numpy()
                own, label, low = (right.column(c).to_numpy() for c in ("anchor_id", "label", "low"))
                asking = matrix(right.column("vector"), width)
                for a in range(0, len(own), ASK_ROWS):
                    for i, s in enumerate(products(asking[a : a + ASK_ROWS], x), a):
                        at = np.flatnonzero((s >= low[i]) & (kinds == label[i]) & (ids != own[i]))
                        at = at[best(s[at], ids[at], k)]
                        for o, v in zip(out, (np.full(len(at), own[i]), ids[at], s[at]), strict=True):
                            o.append(v)
            return _table(("anchor_id", "positive_id", "positive_score"), out)

        found = meet(self.rows.select("bucket", F.col("leaf").alias("cell"), "vec_id", "label", "vector"), asked, ("bucket", "cell"), scored, "anchor_id long, positive_id long, positive_score long", self.tables)
        order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
        return self.tables.keep(found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k))

    def negatives(self, asked: DataFrame, k: int) -> DataFrame:
        """(anchor_id, place, rank, negative_id, negative_score): for each window (floors and tops by place) of an anchor, the highest scores among the rows of the leaves."""
        width = self.width

        def scored(left: pa.Table, right: pa.Table) -> pa.Table:
            out: list[list] = [[], [], [], []]
            if left.num_rows and right.num_rows:
                ids, x, kinds = left.column("vec_id").to_numpy(), matrix(left.column("vector"), width), left.column("label").to_numpy()
                own, label = right.column("anchor_id").to_numpy(), right.column("label").to_numpy()
                floors, tops = right.column("floors").to_pylist(), right.column("tops").to_pylist()
                asking = matrix(right.column("vector"), width)
                for a in range(0, len(own), ASK_ROWS):
                    for i, s in enumerate(products(asking[a : a + ASK_ROWS], x), a):
                        for place, (floor, top) in enumerate(zip(floors[i], tops[i], strict=True), 1):
                            at = np.flatnonzero((s >= floor) & (s <= top) & (kinds != label[i]) & (ids != own[i]))
                            at = at[best(s[at], ids[at], k)]
                            for o, v in zip(out, (np.full(len(at), own[i]), np.full(len(at), place), ids[at], s[at]), strict=True):
                                o.append(v)
            return _table(("anchor_id", "place", "negative_id", "negative_score"), out)

        found = meet(self.rows.select(F.col("leaf").alias("cell"), "vec_id", "label", "vector"), asked, ("cell",), scored, "anchor_id long, place long, negative_id long, negative_score long", self.tables)
        order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
        return self.tables.keep(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))


def _schema(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def _table(names: tuple[str, ...], columns: list[list]) -> pa.Table:
    return pa.table({c: np.concatenate(x) if x else np.zeros(0, np.int64) for c, x in zip(names, columns, strict=True)})


def _one_length(rows: DataFrame, anchors: DataFrame, width: int, positives: int, negatives: int, lower: int, upper: int, tables: Tables) -> DataFrame:
    s = _Search(rows, anchors, width, tables)
    asked = s.anchors.withColumns({"low": F.lit(LEAST).cast("long"), "high": F.lit(MOST).cast("long")})
    first = s.positives(s.promising(asked, "bucket"), positives)
    kth = first.filter(F.col("place") == positives).select("anchor_id", F.col("positive_score").alias("_k"))
    asked = asked.join(kth, "anchor_id", "left").withColumn("low", F.coalesce("_k", "low")).drop("_k")
    best_of = s.positives(s.surviving(tables.keep(asked), "bucket"), positives)

    spans = best_of.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("place", F.col("positive_score").alias("s")))).alias("_p"))
    floors = F.expr(f"transform(_p, p -> if(p.s < 0, 1L, ({lower}L * p.s + 99) div 100))")  # a negative score has no window
    tops = F.expr(f"transform(_p, p -> if(p.s < 0, 0L, {upper}L * p.s div 100))")
    spans = spans.select("anchor_id", floors.alias("floors"), tops.alias("tops"))

    def looking(df: DataFrame) -> DataFrame:
        return df.withColumns({"low": F.array_min("floors"), "high": F.array_max("tops")}).filter("low <= high")

    asked = looking(s.anchors.join(spans, "anchor_id"))
    seeds = s.negatives(s.promising(tables.keep(asked), "all"), negatives)
    thirds = seeds.filter(F.col("rank") == negatives).groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("place", "negative_score"))).alias("_m"))
    raised = F.transform("floors", lambda f, i: F.coalesce(F.try_element_at("_m", (i + 1).cast("long")), f))
    asked = looking(asked.join(thirds, "anchor_id", "left").withColumn("floors", F.when(F.col("_m").isNull(), F.col("floors")).otherwise(raised)).drop("_m"))
    found = s.negatives(s.surviving(tables.keep(asked), "all"), negatives)
    pairs = best_of.select("anchor_id", F.col("place").cast("long").alias("place"), "positive_id", "positive_score")
    return found.join(pairs, ["anchor_id", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, lower: int = 50, upper: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from rows and anchors (vec_id, label, integer vector); lower and upper are percents of the positive's score."""
    if not 0 <= lower < upper:
        raise ValueError("0 <= lower < upper")
    rows, anchors = rows.filter(F.col("label").isNotNull()), anchors.filter(F.col("label").isNotNull())
    tables, out = Tables(rows.sparkSession), None
    for (width,) in sorted(anchors.select(F.size("vector")).distinct().collect()):
        same = F.size("vector") == width
        got = _one_length(rows.filter(same), anchors.filter(same), width, positives, negatives, lower, upper, tables)
        out = got if out is None else out.unionByName(got)
    return rows.sparkSession.createDataFrame([], RESULT) if out is None else out


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = scaled(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 256, "label")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, rows.filter(F.col("vec_id") % 50 == 0))


OP11_SQL = f"""WITH {vectors_sql(256, ", CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label")},
a AS (SELECT anchor_id, x.label AS label, x.v AS v FROM (SELECT vec_id AS anchor_id, min({{'label': label, 'v': v}}) AS x FROM v WHERE vec_id % 50 = 0 AND label IS NOT NULL GROUP BY 1)),
s AS (SELECT a.anchor_id, a.label = b.label AS same, b.vec_id, {PRODUCT_SQL} AS score FROM a JOIN v b ON b.vec_id <> a.anchor_id AND b.label IS NOT NULL AND len(a.v) = len(b.v)),
p AS (SELECT anchor_id, vec_id, score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same),
n AS (
  SELECT anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, place ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE place <= 5 AND NOT same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""
