"""Mixing sources to target weights by a time-varying curriculum (DataFrame operations only).

Sources in order of code point, null last, weigh 1, 2, 3, repeating, unless
weights are given, and share the sum of all sizes in words. A target stops at
`max_repeats` times its source's size; what is over goes to the others by
weight until none is above. Each source is laid out in order of the MD5 of a
document's doc_id and text, again and again; the mix takes its first `target`
words, so a document is taken wholly, several times, or (one document a source)
in part. Prefix sums run within (source, leading hex digits) cells and over the
bounded table of cell totals, so no source is ever in one task.

The curriculum gives each source a weight that changes linearly over training
time t in [0, 1], `early` at t = 0 to `late` at t = 1 (odd places in the order of
sources start high, even ones low). Its integral, inverted at a copy's share of
the source's target, is that copy's position; rows are range-sorted by position.

Null texts have size 0 and are never taken. Empty tables give no rows. Rows alike in
doc_id and text may swap their takes. The table of sources, a row each, is worked on
in one task. Added columns replace those of the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WORDS = r"[^\x20\x09-\x0D]++"
#: Hex digits of the MD5 that make a cell: 4096 cells a source.
DIGITS = 3


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, max_repeats: int = 3, weights: list[int] | None = None) -> DataFrame:
    """(source, source_size, source_rank, target) from (source, source_size): water-filling under max_repeats times the size.

    A source is capped when the level (words a unit of weight) reaches its cap
    over its weight; in order of that ratio, the level that uses up the total is
    found by prefix sums. The table has a row a source.
    """
    weights = weights or [1, 2, 3]
    by_code = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    s = sizes.withColumn("source_rank", F.row_number().over(by_code) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_rank") % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", (max_repeats * F.col("source_size")).cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy()
    before = Window.orderBy("ratio", "source_rank").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("total", F.sum("source_size").over(everything))
    s = s.withColumn("spent", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("rest", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("level", (F.col("total") - F.col("spent")) / F.col("rest"))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source_rank", "level"))).over(everything)["level"]
    s = s.withColumn("target", F.least("cap", F.col("weight") * level))
    return s.select("source", "source_size", "source_rank", "target")


def curriculum_time(share, rising, early: float = 1.5, late: float = 0.5):
    """Time at which a source has used up a share of its target: the inverse of the integral of its linear weight.

    Falling weight: w(t) = early + (late - early) t, normalised to integral 1; a
    rising one swaps the two.
    """
    a = F.when(rising, F.lit(late)).otherwise(F.lit(early))
    b = F.when(rising, F.lit(early)).otherwise(F.lit(late))
    mean = (early + late) / 2
    slope = (b - a) / (2 * mean)
    start = a / mean
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * share / (start + F.sqrt(start * start + 4 * slope * share))))


def _source_key():
    """A key of the source that is never null."""
    return F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"), F.coalesce("source", F.lit("")))


def plan(docs: DataFrame, max_repeats: int = 3, weights: list[int] | None = None) -> DataFrame:
    """All columns of docs with size, source_size, target, taken (words), and first_position (null if nothing is taken).

    Added columns replace those of the same name.
    """
    d = docs.withColumn("size", word_count(F.col("text"))).withColumn("_key", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.md5("text"), F.lit("")))))
    d = d.withColumn("_cell", F.substring("_key", 1, DIGITS)).withColumn("_sk", _source_key()).drop("source_size", "source_rank", "target", "_cell_start")
    cells = d.groupBy("_sk", "_cell").agg(F.sum("size").alias("_cell_size"))
    per_source = cells.groupBy("_sk").agg(F.sum("_cell_size").alias("source_size"))
    per_source = per_source.select(F.when(F.col("_sk").startswith("0"), F.expr("substring(_sk, 2)")).alias("source"), "source_size")
    goal = targets(per_source, max_repeats, weights).withColumn("_sk", _source_key()).drop("source")
    upto = Window.partitionBy("_sk").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_cell_start", F.coalesce(F.sum("_cell_size").over(upto), F.lit(0))).drop("_cell_size").join(goal, "_sk")
    # one exchange by (source, cell) serves this join and the window
    d = d.join(cells, ["_sk", "_cell"])
    inside = Window.partitionBy("_sk", "_cell").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_start", F.col("_cell_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    want = F.round("target").cast("long")
    laps = F.when(F.col("source_size") > 0, F.floor(want / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = want - laps * F.col("source_size")
    last = F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("_start")))
    d = d.withColumn("taken", (laps * F.col("size") + last).cast("long"))
    share = (F.col("_start") + F.least(F.col("size"), F.col("taken")) / 2) / F.col("target")
    d = d.withColumn("first_position", F.when(F.col("taken") > 0, curriculum_time(share, F.col("source_rank") % 2 == 1)))
    return d.drop("_key", "_sk", "_cell", "_cell_start")


def mix(docs: DataFrame, max_repeats: int = 3, weights: list[int] | None = None) -> DataFrame:
    """The mixed corpus: columns of docs, a row for each copy taken, range-sorted by `position`; a copy taken in part ends after its words."""
    names = [c for c in docs.columns if c != "position"]
    inner = {c: c if c in ("doc_id", "text", "source") else f"_own_{i}" for i, c in enumerate(names)}
    d = plan(docs.select(*[F.col(c).alias(n) for c, n in inner.items()]), max_repeats, weights).filter(F.col("taken") > 0)
    whole = F.floor(F.col("taken") / F.col("size")).cast("int")
    part = F.col("taken") - whole * F.col("size")
    d = d.withColumn("_copy", F.explode(F.sequence(F.lit(0), whole + F.when(part > 0, 0).otherwise(-1))))
    words = F.when(F.col("_copy") < whole, F.col("size")).otherwise(part)
    pieces = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++"), F.lit(0))
    cut = F.array_join(F.slice(pieces, 1, part.cast("int")), "")
    d = d.withColumn("text", F.when(F.col("_copy") < whole, F.col("text")).otherwise(cut))
    share = (F.col("_start") + F.col("_copy") * F.col("source_size") + words / 2) / F.col("target")
    d = d.withColumn("position", curriculum_time(share, F.col("source_rank") % 2 == 1))
    return d.select(*[F.col(n).alias(c) for c, n in inner.items()], "position").repartitionByRange(F.col("position"), F.col("doc_id")).sortWithinPartitions("position", "doc_id")


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    d = plan(docs).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", F.round("first_position", 9).alias("first_position"))
    return d.repartitionByRange(F.col("first_position"), F.col("doc_id")).sortWithinPartitions("first_position", "doc_id")


OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(md5(text), '')) AS k
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS r
  FROM d GROUP BY source),
w AS (SELECT *, (r % 3 + 1)::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap, sum(source_size) OVER () AS total FROM s),
fill(step, source, weight, cap, target, done) AS (
  SELECT 0, source, weight, cap, total * weight / sum(weight) OVER (), false FROM w
  UNION ALL
  SELECT step + 1, source, weight, cap,
         CASE WHEN done OR target >= cap THEN cap
              ELSE target + excess * weight / nullif(open_weight, 0) END, done OR target >= cap
  FROM (SELECT *, sum(CASE WHEN NOT done AND target > cap THEN target - cap ELSE 0 END) OVER () AS excess,
               sum(CASE WHEN NOT done AND target < cap THEN weight ELSE 0 END) OVER () AS open_weight FROM fill)
  WHERE step < 100),
t AS (SELECT w.source, w.source_size, w.r, least(f.target, f.cap) AS target FROM w JOIN fill f ON w.source IS NOT DISTINCT FROM f.source AND f.step = 100),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.r, t.target,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
         round(t.target)::BIGINT AS want
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (
  SELECT *, CASE WHEN source_size > 0 THEN want // source_size ELSE 0 END AS laps FROM p),
u AS (
  SELECT *, (laps * size + greatest(0, least(size, want - laps * source_size - start)))::BIGINT AS taken FROM q),
v AS (
  SELECT *, (start + least(size, taken) / 2.0::DOUBLE) / target AS share,
         CASE WHEN r % 2 = 1 THEN 0.5 ELSE 1.5 END::DOUBLE AS a, CASE WHEN r % 2 = 1 THEN 0.5 ELSE -0.5 END::DOUBLE AS b FROM u)
SELECT doc_id, size, source_size, round(target, 6) AS target, taken,
       CASE WHEN taken > 0 THEN round(least(1.0, greatest(0.0, 2 * share / (a + sqrt(a * a + 4 * b * share)))), 9) END AS first_position
FROM v
"""
