"""Quality rules with cross-document line frequency (DataFrame operations only).

Base rule: too few words, or too many words inside repeated 8-word windows. The
method: a line is normalised (A-Z lower-cased, white space squeezed, digits to
0) and hashed; documents that hold it are counted by host (here: source); a line
in more documents of its host than `max_share` of them, and than `max_docs`, is
removed, and a document that keeps less than `min_kept` of its words, or fewer than
the base rule asks for, is depleted and rejected.

A row is one document; repeated rows are documents each. Null texts have no words.
Hosts may be null. An empty table gives no rows. Ties: a line in just as many
documents as the limit stays. A host or line with a third of all rows meets only
partial aggregates and a join whose other side has one row a (host, line). The
(host, line, document, place) rows are written once, as a table in the shared folder.
Lines are taken out of a text by their places, so that time grows with the number of
lines, removed or not. Equal (host, text) are told apart by two 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm._text import Tables

BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
MIN_WORDS, MAX_REPEAT = 20, 30
WINDOW = 8


def words(text):
    """Words `[^\\x20\\x09-\\x0D]+` as an array; null text: none."""
    inner = F.coalesce(F.btrim(text, F.lit(BLANKS)), F.lit(""))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]++", -1))


def _lines():
    """Lines of the text that have a word."""
    return F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)


def base_stats(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    Window hashes are looked at further only if a text has equal ones; then
    positions are sorted by hash, neighbours of equal hash are marked, and the
    union of the marked windows is measured over positions in order.
    """
    none = F.array().cast("array<bigint>")
    d = docs.withColumn("_w", words(F.col("text")))
    d = d.withColumn("_h", F.transform("_w", lambda x: F.xxhash64(x)))
    d = d.withColumn("_lines", _lines())
    long = F.size("_h") > WINDOW
    at = lambda i, k: F.get("_h", i + (k - 1))
    d = d.withColumn("_g", F.when(long, F.transform(F.sequence(F.lit(1), F.size("_h") - (WINDOW - 1)), lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)]))).otherwise(none))
    d = d.withColumn("_odd", F.size("_g") != F.size(F.array_distinct("_g")))
    pairs = F.array_sort(F.transform("_g", lambda x, i: F.struct(x.alias("h"), (i + 1).alias("i"))))
    d = d.withColumn("_p", F.when(F.col("_odd"), pairs))
    same = lambda i, j: F.coalesce(F.get("_p", i)["h"] == F.get("_p", j)["h"], F.lit(False))
    marked = F.array_sort(F.transform(F.filter("_p", lambda x, i: same(i, i - 1) | same(i, i + 1)), lambda x: x["i"]))
    d = d.withColumn("_m", F.when(F.col("_odd"), marked))
    steps = F.transform("_m", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_m", i + 1) - x, F.lit(WINDOW))))
    covered = F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)
    return d.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": F.coalesce(F.regexp_count("text", F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.when(F.col("_odd"), covered).otherwise(F.lit(0)).cast("long"),
        }
    ).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))).drop("_w", "_h", "_lines", "_g", "_odd", "_p", "_m")


def normal_line(line):
    """A-Z lower-cased, ASCII white space squeezed and trimmed, digits to 0."""
    low = F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000")
    return F.btrim(F.regexp_replace(low, r"[\x20\x09-\x0D]++", " "))


def assess(docs: DataFrame, host: str = "source", max_docs: int = 20, max_share: float = 0.002, min_kept: float = 0.5) -> DataFrame:
    """All columns of docs with the base statistics, n_removed_lines, n_kept_words, depleted, kept, and clean_text (null unless kept).

    Lines of under three words are never removed: they are labels and list
    marks. Added columns replace those of the same name.
    """
    row = F.struct(F.xxhash64("_host", "text").alias("a"), F.xxhash64(F.lit("row"), "text", "_host").alias("b"))
    docs = docs.withColumn("_host", F.col(host)).withColumn("_row", row)
    held = docs.select("_host", "_row", F.monotonically_increasing_id().alias("_doc"), F.posexplode(F.split("text", "\n", -1)).alias("_at", "_line"))
    held = held.withColumn("_n", F.regexp_count("_line", F.lit(r"[^\x20\x09-\x0D]++"))).filter("_n >= 3").withColumn("_line", F.xxhash64(normal_line(F.col("_line"))))
    held = Tables(docs.sparkSession).keep(held)
    counts = held.select("_host", "_line", "_doc").distinct().groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_docs"))
    size = docs.groupBy(F.col("_host").alias("_sh")).agg((F.count(F.lit(1)) * max_share).alias("_size"))
    common = counts.filter(F.col("_docs") > max_docs).join(size, F.col("_host").eqNullSafe(F.col("_sh"))).filter("_docs > _size").select(F.col("_host").alias("_ch"), F.col("_line").alias("_cl"))
    bad = held.join(common, held["_host"].eqNullSafe(F.col("_ch")) & (held["_line"] == F.col("_cl")), "left_semi")
    # equal rows have equal lines, so their places are one set
    bad = bad.groupBy(F.col("_row").alias("_br")).agg(F.collect_set(F.struct("_at", "_n")).alias("_bad"))
    d = base_stats(docs)
    d = d.join(bad, d["_row"] == bad["_br"], "left").drop("_br")
    gone = F.coalesce(F.aggregate("_bad", F.lit(0).cast("long"), lambda a, x: a + x["_n"]), F.lit(0))
    d = d.withColumn("n_removed_lines", F.coalesce(F.size("_bad"), F.lit(0)).cast("long"))
    d = d.withColumn("n_kept_words", F.col("n_words") - gone)
    d = d.withColumn("depleted", (F.col("n_kept_words") < MIN_WORDS) | (F.col("n_kept_words") < min_kept * F.col("n_words")))
    d = d.withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
    lines = F.split("text", "\n", -1)
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.transform("_bad", lambda x: x["_at"]))
    d = d.withColumn("_lines", F.when(F.col("kept") & (F.col("n_removed_lines") > 0), lines))
    d = d.withColumn("_places", F.when(F.col("_lines").isNotNull(), places))
    clean = F.array_join(F.transform("_places", lambda i: F.get("_lines", i)), "\n")
    d = d.withColumn("clean_text", F.when(F.col("kept"), F.when(F.col("n_removed_lines") > 0, clean).otherwise(F.col("text"))))
    return d.drop("_host", "_row", "_bad", "_lines", "_places")


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return assess(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines", "n_kept_words")


OP10_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (SELECT rid, i, array_to_string(w[i:i+7], ' ') AS gram FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
m AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c > 1),
r AS (SELECT rid, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM m) GROUP BY rid),
b AS (
  SELECT rid, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN r USING (rid)),
l AS (
  SELECT rid, source, trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS nl,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS nw
  FROM (SELECT rid, source, unnest(lines) AS line FROM d)),
z AS (SELECT source, count(*) * 0.002 AS size FROM documents GROUP BY source),
c AS (SELECT l.source, nl FROM l JOIN z ON l.source IS NOT DISTINCT FROM z.source WHERE nw >= 3 GROUP BY l.source, nl, z.size HAVING count(DISTINCT rid) > greatest(20, z.size)),
k AS (
  SELECT l.rid, sum(CASE WHEN c.nl IS NULL THEN 0 ELSE 1 END)::BIGINT AS removed, sum(CASE WHEN c.nl IS NULL THEN nw ELSE 0 END)::BIGINT AS kept_words
  FROM l LEFT JOIN c ON l.source IS NOT DISTINCT FROM c.source AND l.nl = c.nl GROUP BY l.rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND coalesce(kept_words, 0) >= 20 AND coalesce(kept_words, 0) >= 0.5 * n_words AS kept,
       coalesce(removed, 0) AS n_removed_lines, coalesce(kept_words, 0) AS n_kept_words
FROM b LEFT JOIN k USING (rid)
"""
