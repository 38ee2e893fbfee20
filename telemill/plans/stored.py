"""Queries over a stored history: keyset pages and indexed search."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

from telemill import schemas
from telemill.operators import access, history, sinks
from telemill.operators.history import Search
from telemill.plans.queries import ORACLES
from telemill.plans.registry import query
from telemill.sources import tables
from telemill.sources.scratch import folder

STORED = StructType([*[StructField(f.name, f.dataType) for f in schemas.INVOCATION], StructField(access.DAY, DateType())])


def stored(spark, d) -> str:
    """The history by day, in several files a day."""
    path = f"{folder(spark, 'stored')}/history"
    sinks.write_history(tables.invocations(spark, d).drop("finish_seq").repartitionByRange(6, "started"), path)
    return path


@query(ORACLES["inv_page2"])
def inv_seek(spark, d):
    """The second page, by the last row of the first."""
    inv = spark.read.schema(STORED).parquet(stored(spark, d))
    s = Search(model="m3", state="completed")
    last = access.seek(inv, s).select("started", "id").collect()[-1:]  # a page
    return access.seek(inv, s, tuple(last[0]) if last else None).filter(F.lit(bool(last)))


@query(ORACLES["inv_search_ascii"])
def inv_search_indexed(spark, d):
    path = stored(spark, d)
    index = f"{folder(spark, 'index')}/grams"
    access.build_index(spark.read.schema(STORED).parquet(path)).write.parquet(index)
    s = Search(q="C2CLICK", source="c2", since=1704500000.0)
    return history.page(access.indexed(spark, path, STORED, spark.read.parquet(index), s), s)
