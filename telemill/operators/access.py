"""A stored history (see sinks.write_history) read in part: keyset pages by day, and text search that skips files.

A page after a cursor needs the newest rows only. Days are opened from the cursor's on,
1, 2, 4, ... at a time, until they hold a page; each look is a top-k whose filter prunes
day partitions, so a deep page costs what the first one does, unlike an offset.

The search index has, for each file, a Bloom bitmap of the hashes of all three-character
pieces of the rows' texts (ASCII-folded, as the search folds them). A file that lacks one
of the needle's pieces cannot hold the needle and isn't read; the exact search runs over
the others. Files that the index doesn't know are always read, so it may lag behind; a
needle of fewer than three characters reads all. Names of files, one each, and of days
are what reaches the driver.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.functions.text import LOWER, UPPER, ascii_lower
from telemill.operators.history import PAGE, Search, listing, matching

DAY = "started_date"
#: Bits of a file's bitmap, in sections that the builtin bitmaps hold.
SECTION, SECTIONS = 32768, 32
GRAM = 3


def searched() -> Column:
    """The text that a search goes through."""
    blank = F.lit("")
    return ascii_lower(F.concat(F.coalesce("request", blank), F.coalesce("response", blank), F.coalesce("source", blank), F.coalesce("purpose", blank)))


def seek(inv: DataFrame, s: Search, after: tuple[float, str] | None = None, days: list | None = None, size: int = PAGE) -> DataFrame:
    """The rows that come after a cursor, (started, id) of the last row seen, in order newest first, ties by id; the search's offset is not used.

    days: the day partitions, if the caller knows them; else they are listed.
    """
    if days is None:
        days = [r[0] for r in inv.select(DAY).distinct().collect()]  # a row a day
    rows = matching(inv, s)
    if after is not None:
        started, identifier = after
        rows = rows.filter((F.col("started") < started) | ((F.col("started") == started) & (F.col("id") > identifier)))
        border = inv.sparkSession.range(1).select(F.to_date(F.timestamp_micros(F.round(F.lit(started) * 1e6).cast("bigint")))).first()[0]
        days = [d for d in days if d is not None and d <= border]
    newest, n = sorted((d for d in days if d is not None), reverse=True), 1
    while True:
        opened = rows.filter(F.col(DAY) >= newest[min(n, len(newest)) - 1]) if newest else rows.limit(0)
        if after is not None and newest:
            opened = opened.filter(F.col(DAY) <= newest[0])
        page = listing(opened).orderBy(F.desc("started"), "id").limit(size)
        if n >= len(newest) or page.count() == size:
            return page
        n *= 2


def _hash(piece: Column) -> Column:
    return F.pmod(F.xxhash64(piece), F.lit(SECTION * SECTIONS))


def _place(h: Column) -> tuple[Column, Column]:
    """Section and bit of a hash."""
    return (h / SECTION).cast("int"), F.pmod(h, F.lit(SECTION))


def build_index(inv: DataFrame) -> DataFrame:
    """(file, section, bits) of a history read from files; sections without a piece have no row, and a file without any text one with an empty bitmap."""
    text = searched()
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.length("_t") - (GRAM - 1), F.lit(1))), lambda i: _hash(F.substr(F.col("_t"), i, F.lit(GRAM))))
    d = inv.select(F.col("_metadata.file_path").alias("file"), text.alias("_t")).select("file", F.explode(F.array_distinct(pieces)).alias("h"))
    section, bit = _place(F.col("h"))
    return d.groupBy("file", section.alias("section")).agg(F.bitmap_construct_agg(bit).alias("bits"))


def without(index: DataFrame, needle: str) -> DataFrame:
    """(file) of indexed files that cannot hold the needle."""
    spark = index.sparkSession
    low = needle.translate(str.maketrans(UPPER, LOWER))
    grams = sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})
    wanted = spark.createDataFrame([(g,) for g in grams], "gram string").select(_hash(F.col("gram")).alias("h")).distinct()
    section, bit = _place(F.col("h"))
    wanted = wanted.select(section.alias("section"), bit.alias("bit")).groupBy("section").agg(F.collect_list("bit").alias("wanted"))
    byte = lambda b: F.conv(F.hex(F.substr(F.col("bits"), (b / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.forall("wanted", lambda b: F.pmod(F.floor(byte(b) / F.pow(F.lit(2), F.pmod(b, F.lit(8)))), F.lit(2)) == 1)
    n = wanted.agg(F.count(F.lit(1)).alias("sections"))
    found = index.join(F.broadcast(wanted), "section").filter(held).groupBy("file").agg(F.count(F.lit(1)).alias("n"))  # one row a section, at most SECTIONS
    known = index.select("file").distinct()
    return known.join(found, "file", "left").crossJoin(n).filter("coalesce(n, 0) < sections").select("file")


def _plain(file: str) -> str:
    """A file's address with one slash after a scheme without a host."""
    return re.sub(r"^(\w+):///", r"\1:/", file)


def indexed(spark: SparkSession, path: str, schema, index: DataFrame, s: Search) -> DataFrame:
    """The stored history as the search has to read it: without files that cannot hold its text."""
    inv = spark.read.schema(schema).parquet(path)
    if len(s.q) < GRAM:
        return inv
    out = {_plain(r[0]) for r in without(index, s.q).collect()}  # names of files
    files = [f for f in inv.inputFiles() if _plain(f) not in out]
    if not files:
        return inv.limit(0)
    return spark.read.schema(schema).option("basePath", path).parquet(*files)
