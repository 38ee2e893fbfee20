"""A durable history: transitions are committed batch by batch, compacted into rows by day, and retained for a time.

    log/batch=N/day=D    start and finish rows of micro-batch N; a replayed batch replaces its rows
    rows/day=D           one row a request, by the day it started
    retained             when retention last ran

Reading folds the log over the rows of the days it touches. Compaction does the same
and replaces just these days, then removes the batches it read. Folding the same rows
again changes nothing, so a run that is cut off anywhere, and a batch that comes again
after its compaction, do no harm. There is one writer; a reader that meets the moment
in which a day is replaced has to read again.

A finish may come before its start; its row waits without one and isn't read until then.
Of several finishes of an id the last by `finish_seq` counts, a null one least.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.operators.history import RESTARTED, terminal_state

FIRST = "started double, model string, endpoint string, source string, purpose string, request string"
OUTCOME = "status int, duration double, ttft double, prompt_tokens long, generated_tokens long, response string, truncated boolean, error string"
LOG = f"id string, s struct<{FIRST.replace(' ', ': ').replace(',: ', ', ')}>, finish_seq long, f struct<{OUTCOME.replace(' ', ': ').replace(',: ', ', ')}>"
ROWS = f"id string, {FIRST}, {OUTCOME}, finish_seq long, finished boolean, state string"
#: Files that a compacted day is written to, about.
FILES_A_DAY = 8


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def day_of(started: Column) -> Column:
    return F.to_date(F.timestamp_micros((started * 1_000_000).cast("long")))


def start_rows(rows: DataFrame) -> DataFrame:
    """Transitions of requests that begin."""
    none = F.lit(None)
    return rows.select("id", F.struct(*_names(FIRST)).alias("s"), none.cast("long").alias("finish_seq"), none.cast(f"struct<{LOG.split('f struct<')[1]}").alias("f"), day_of(F.col("started")).alias("day"))


def finish_rows(rows: DataFrame) -> DataFrame:
    """Transitions of requests that end; they know when the request started, which says its day."""
    none = F.lit(None).cast(LOG.split("s ", 1)[1].split(", finish_seq")[0])
    return rows.select("id", none.alias("s"), "finish_seq", F.struct(*_names(OUTCOME)).alias("f"), day_of(F.col("started")).alias("day"))


class Folder:
    """Names and removal of folders, by the file system of the path: no data passes through it."""

    def __init__(self, spark: SparkSession, home: str):
        self.home, self.spark = home, spark
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(home).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def parts(self, name: str, key: str) -> list[str]:
        """Values of a partition column."""
        p = self.path(f"{self.home}/{name}")
        if not self.fs.exists(p):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(p)]
        return sorted(n.removeprefix(f"{key}=") for n in names if n.startswith(f"{key}="))

    def remove(self, *names: str) -> None:
        for n in names:
            self.fs.delete(self.path(f"{self.home}/{n}"), True)

    def read(self, name: str, schema: str) -> DataFrame:
        if not self.fs.exists(self.path(f"{self.home}/{name}")):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.home}/{name}")

    def replace_days(self, name: str, rows: DataFrame) -> None:
        """Replaces the days that the rows belong to; other days stay as they are."""
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{self.home}/{name}")


def expire(folder: Folder, name: str, schema: str, border: str, stays: Column, keep: Column | None = None) -> list[str]:
    """Removes from a table by day what is older than a moment of the day `border`: earlier days as a whole, without reading them, and from the border's day all rows but those that `stays` holds for.

    keep: rows that stay however old they are; then the earlier days are read for them,
    that column alone, and those that hold some are rewritten. Gives the days that were
    rewritten.
    """
    old = [d for d in folder.parts(name, "day") if d < border and d != "__HIVE_DEFAULT_PARTITION__"]
    table = folder.read(name, f"{schema}, day date")
    held = F.col("day").cast("string")
    rewritten = []
    if keep is not None and old:
        rewritten = [r[0] for r in table.filter(F.col("day") < F.lit(border).cast("date")).filter(keep).select(held.alias("d")).distinct().collect()]  # a row a day
    if border in folder.parts(name, "day"):
        at_border = table.filter(F.col("day") == F.lit(border).cast("date"))
        if at_border.filter(~stays).isEmpty():
            pass
        elif at_border.filter(stays).isEmpty():
            old.append(border)
        else:
            rewritten.append(border)
    if rewritten:
        days = F.col("day").isin([F.lit(d).cast("date") for d in rewritten])
        folder.replace_days(name, table.filter(days).filter(stays))
    folder.remove(*[f"{name}/day={d}" for d in old if d not in rewritten])
    return sorted(rewritten)


class History:
    def __init__(self, spark: SparkSession, home: str):
        self.spark, self.folder = spark, Folder(spark, home)

    def commit(self, batch: DataFrame, number: int) -> None:
        """Writes a batch of transitions (see start_rows and finish_rows); a sink for foreachBatch."""
        batch.write.mode("overwrite").partitionBy("day").parquet(f"{self.folder.home}/log/batch={number}")

    def _log(self, batches: list[str]) -> DataFrame:
        return self.folder.read("log", f"{LOG}, batch int, day date").filter(F.col("batch").isin([int(b) for b in batches])).drop("batch")

    def _folded(self, rows: DataFrame, log: DataFrame) -> DataFrame:
        """Rows with the log's transitions; a row of each id and day."""
        first, outcome = _names(FIRST), _names(OUTCOME)
        kept = rows.select(
            "id",
            F.when(F.col("started").isNotNull(), F.struct(*first)).alias("s"),
            "finish_seq",
            F.when(F.col("finished"), F.struct(*outcome)).alias("f"),
            "day",
            (F.col("state") == "interrupted").alias("lost"),
        )
        both = kept.unionByName(log.withColumn("lost", F.lit(False))).withColumn("_slot", F.pmod(F.xxhash64("id"), F.lit(FILES_A_DAY)))
        # one exchange, whose tasks are the files of a day
        g = both.repartition("day", "_slot").groupBy("day", "_slot", "id").agg(F.max("s").alias("s"), F.max(F.when(F.col("f").isNotNull(), F.struct(F.coalesce("finish_seq", F.lit(-(1 << 63))).alias("o"), "finish_seq", "f"))).alias("x"), F.max("lost").alias("lost"))
        done = F.col("x").isNotNull()
        flat = g.select("id", "s.*", "x.f.*", "x.finish_seq", done.alias("finished"), "lost", "day")
        state = F.when(F.col("finished"), terminal_state(F.col("status"), F.col("error"))).when(F.col("lost"), "interrupted").otherwise("running")
        error = F.when(~F.col("finished") & F.col("lost"), RESTARTED).otherwise(F.col("error"))
        return flat.withColumn("state", state).withColumn("error", error).select(*_names(ROWS), "day")

    def _stored(self) -> DataFrame:
        return self.folder.read("rows", f"{ROWS}, day date")

    def _touched(self, batches: list[str]) -> tuple[Column, Column]:
        """Whether a row's day is one that these batches write to, or is another."""
        days = sorted({d for b in batches for d in self.folder.parts(f"log/batch={b}", "day")})
        day, dated = F.col("day"), [d for d in days if d[0].isdigit()]
        listed = day.isin([F.lit(d).cast("date") for d in dated])
        if len(dated) < len(days):  # rows without a start time
            return day.isNull() | listed, ~listed
        return listed, day.isNull() | ~listed

    def rows(self) -> DataFrame:
        """The history as it is now."""
        batches = self.folder.parts("log", "batch")
        stored = self._stored()
        if batches:
            touched, other = self._touched(batches)
            stored = stored.filter(other).unionByName(self._folded(stored.filter(touched), self._log(batches)))
        return stored.filter(F.col("started").isNotNull()).drop("finished", "day")

    def compact(self) -> DataFrame | None:
        """Merges the log into the days it touches; the rows that were written, before they were."""
        batches = self.folder.parts("log", "batch")
        if not batches:
            return None
        merged = self._folded(self._stored().filter(self._touched(batches)[0]), self._log(batches))
        self.folder.replace_days("rows", merged)
        self.folder.remove(*[f"log/batch={b}" for b in batches])
        return merged

    def recover(self, boot: float) -> None:
        """After a restart: compacted rows still running that began before become interrupted. Days without such rows aren't rewritten."""
        self.compact()
        lost = (F.col("state") == "running") & (F.col("started") < boot)
        days = [r[0] for r in self._stored().filter(lost).select("day").distinct().collect()]  # a row a day
        if days:
            rows = self._stored().filter(F.col("day").isin(days))
            changed = {"error": F.when(lost, RESTARTED).otherwise(F.col("error")), "state": F.when(lost, "interrupted").otherwise(F.col("state"))}
            self.folder.replace_days("rows", rows.withColumns(changed))

    def retain(self, now: float, days: float, every: float = 3600) -> list[str] | None:
        """Deletes rows that started more than `days` ago and aren't running, at most once in `every` seconds; the days that were rewritten, or None if it wasn't time. days <= 0 keeps all."""
        if days <= 0:
            return None
        last = self.folder.read("retained", "at double").agg(F.max("at")).first()[0]  # one row
        if last is not None and now - last < every:
            return None
        self.compact()
        running = F.col("state") == "running"
        since = now - days * 86400
        border = self.spark.range(1).select(day_of(F.lit(since)).cast("string")).first()[0]
        out = expire(self.folder, "rows", ROWS, border, (F.col("started") >= since) | running, running)
        self.spark.createDataFrame([(float(now),)], "at double").write.mode("append").parquet(f"{self.folder.home}/retained")
        return out
