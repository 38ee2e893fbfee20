"""Rows and those that ask for them, brought together cell by cell in groups of bounded size; and integer vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm._text import Tables

#: Rows of a cell, and rows that ask, that one group holds, about.
BLOCK_ROWS, CHUNK_ROWS = 16384, 2048
#: Rows of a block are scored for so many that ask at a time.
ASK_ROWS = 64


def scaled(vectors: DataFrame, factor: int, *more: str, column: str = "embedding") -> DataFrame:
    """vec_id, the vector as floor(factor * component), and further columns; without rows whose vec_id or vector is null, or that have no component or a null or non-finite one."""
    v = F.col(column)
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform(v, lambda x: F.floor(factor * x.cast("double")))
    return vectors.filter(fine & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("vector"), *more)


def matrix(column, width: int) -> np.ndarray:
    """An array column of integers of one length as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows; sums beyond a long wrap."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    if np.abs(x).max(initial=0) * np.abs(y).max(initial=0) * a.shape[1] < 2.0**53:
        return (x @ y.T).astype(np.int64)
    with np.errstate(over="ignore"):
        return a @ b.T


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    at = np.arange(len(scores))
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def meet(rows: DataFrame, asked: DataFrame, cells: tuple[str, ...], score, schema: str, tables: Tables) -> DataFrame:
    """score(block, chunk) for all blocks of rows and chunks of those that ask of a cell.

    Both are stored tables, or come from one row by row; their number of cells is bounded
    by the caller, and so is the broadcast table of their sizes. Rows are dealt by their place in the table, so that
    rows alike, or a cell with a large share of all rows, spread over many groups.
    """
    per = lambda df, most, name: df.groupBy(*cells).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name))
    sizes = tables.keep(per(rows, BLOCK_ROWS, "_blocks").join(per(asked, CHUNK_ROWS, "_chunks"), list(cells)))

    def dealt(df, own, own_name, other, other_name):
        d = df.withColumn("_place", F.monotonically_increasing_id()).join(F.broadcast(sizes), list(cells))
        d = d.withColumn(own_name, F.pmod(F.xxhash64("_place"), F.col(own)).cast("int"))
        return d.withColumn(other_name, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("_place", "_blocks", "_chunks")

    by = [*cells, "_b", "_c"]
    left, right = dealt(rows, "_blocks", "_b", "_chunks", "_c"), dealt(asked, "_chunks", "_c", "_blocks", "_b")
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(score, schema)
