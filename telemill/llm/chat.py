r"""Chat formatting in budgeted windows (DataFrame operations only).

A turn costs its words plus an overhead. Every window holds the system turn (the
first turn with that role), so what it costs is taken off the budget first; the rest
is the room of a window. Prefix sums of the other turns' costs cut a conversation
into turn-aligned spans: a span is the run of turns whose start falls in one cell
of half the room that is left beside the history (at most `history`, at most a
quarter of the room); a turn that costs more than such a half stands alone. A window
is the system turn, then the latest earlier turns that `history` and the room left
by the span allow, then the span's own turns. So `n_tokens`, the sum of the costs of
all turns in a window, is within the budget; the only windows above it are those in
which one turn alone and the system turn exceed it, and these have no history. Only
assistant text in its own turns bears loss; repeated turns are masked.

A turn is written `<turn ROLE\nTEXT</turn>\n`, a repeated one `<past ROLE\n...`.
In texts and roles `\` becomes `\b` and `<` becomes `\l`; in roles a line feed
becomes `\n`. So `<` never occurs but in a marker, and all is reversible.

Turns are in order of turn, role, text, nulls first; null role and text are
empty. Turns of a null conv_id are one conversation. Repeated rows are turns each; an
empty table gives no windows. One conversation is worked on in one task, as its
digest is one value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUDGET, HISTORY, OVERHEAD = 512, 128, 4
END = "</turn>\n"


def escaped(c):
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescaped(c):
    return F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, window, formatted, loss_spans, n_tokens): loss_spans are [start, end) code point offsets in formatted."""
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("cost", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]++")).cast("long") + OVERHEAD)
    conv = Window.partitionBy("conv_id")
    t = t.withColumn("i", F.row_number().over(conv.orderBy(F.asc_nulls_first("turn"), "role", "text")))
    by = conv.orderBy("i")
    t = t.withColumn("sys", F.col("i").eqNullSafe(F.min(F.when(F.col("role") == "system", F.col("i"))).over(conv)))
    t = t.withColumn("room", F.greatest(F.lit(0), budget - F.coalesce(F.max(F.when(F.col("sys"), F.col("cost"))).over(conv), F.lit(0))))
    own = F.when(F.col("sys"), F.lit(0)).otherwise(F.col("cost"))
    t = t.withColumn("own_cost", own).withColumn("start", F.sum("own_cost").over(by.rowsBetween(Window.unboundedPreceding, 0)) - F.col("own_cost"))
    half = F.greatest(F.lit(1), F.floor((F.col("room") - F.least(F.lit(history), F.floor(F.col("room") / 4))) / 2))
    cell = F.floor(F.col("start") / half)
    big = F.col("own_cost") > half
    t = t.withColumn("first", (F.col("i") == 1) | (cell != F.lag(cell).over(by)) | big | F.lag(big).over(by))
    t = t.withColumn("window", F.sum(F.col("first").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    t = t.withColumn("last", F.max("window").over(conv))
    t = t.withColumn("past", F.least(F.lit(history), F.greatest(F.lit(0), F.col("room") - F.sum("own_cost").over(Window.partitionBy("conv_id", "window")))))
    # windows that begin within `history` tokens after this turn's start may repeat it
    ahead = conv.orderBy("start").rangeBetween(1, history)
    t = t.withColumn("later", F.collect_list(F.when(F.col("first"), F.struct("window", "start", "past"))).over(ahead))
    near = F.transform(F.filter("later", lambda x: (x["window"] > F.col("window")) & (x["start"] - F.col("start") <= x["past"])), lambda x: x["window"])
    t = t.withColumn("w", F.explode(F.when(F.col("sys"), F.sequence(F.lit(0).cast("long"), F.col("last"))).otherwise(F.concat(F.array("window"), near))))
    t = t.withColumn("own", F.col("w") == F.col("window"))
    g = t.groupBy("conv_id", "w").agg(F.array_sort(F.collect_list(F.struct((~F.col("sys") | F.col("own")).alias("after"), "i", "own", "role", "text", "cost"))).alias("turns"))
    role = lambda x: F.replace(escaped(x["role"]), F.lit("\n"), F.lit("\\n"))
    head = lambda x: F.concat(F.when(x["own"], F.lit("<turn ")).otherwise(F.lit("<past ")), role(x), F.lit("\n"))
    g = g.withColumn("parts", F.transform("turns", lambda x: F.struct(head(x).alias("head"), escaped(x["text"]).alias("body"), (x["own"] & (x["role"] == "assistant")).alias("loss"))))
    g = g.withColumn("n_tokens", F.aggregate("turns", F.lit(0).cast("long"), lambda a, x: a + x["cost"]))
    g = g.withColumn("formatted", F.array_join(F.transform("parts", lambda x: F.concat(x["head"], x["body"], F.lit(END))), ""))
    # a fold that keeps the offset reached and the spans met; spans a window are bounded by its budget
    none = F.expr("cast(array() as array<struct<start: int, end: int>>)")
    fold = F.aggregate(
        "parts",
        F.struct(F.lit(0).alias("at"), none.alias("spans")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["head"]) + F.length(x["body"]) + len(END)).alias("at"),
            F.when(x["loss"], F.concat(a["spans"], F.array(F.struct((a["at"] + F.length(x["head"])).alias("start"), (a["at"] + F.length(x["head"]) + F.length(x["body"])).alias("end"))))).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    return g.select("conv_id", F.col("w").cast("long").alias("window"), "formatted", fold.alias("loss_spans"), "n_tokens")


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns: array of (role, text), loss: array of texts, formatted_chars, n_windows, max_tokens) parsed from the windows alone."""
    pieces = F.filter(F.split("formatted", END), lambda x: x.startswith("<turn "))
    body = F.transform(pieces, lambda x: F.substring(x, F.lit(7), F.length(x)))
    split = lambda x: F.instr(x, F.lit("\n"))
    back = lambda r: unescaped(F.replace(r, F.lit("\\n"), F.lit("\n")))
    turns = F.transform(body, lambda x: F.struct(back(F.substring(x, F.lit(1), split(x) - 1)).alias("role"), unescaped(F.substring(x, split(x) + 1, F.length(x))).alias("text")))
    loss = F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    p = formatted.select("conv_id", "window", turns.alias("turns"), loss.alias("loss"), F.length("formatted").alias("chars"), "n_tokens")
    g = p.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "turns", "loss"))).alias("all"), F.sum("chars").cast("long").alias("formatted_chars"), F.count(F.lit(1)).alias("n_windows"), F.max("n_tokens").alias("max_tokens"))
    flat = lambda name: F.flatten(F.transform("all", lambda x: x[name]))
    return g.select("conv_id", flat("turns").alias("turns"), flat("loss").alias("loss"), "formatted_chars", "n_windows", "max_tokens")


def op4_chat_formatting(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    text = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    extra = extra.select(*[F.col(f.name).cast(f.dataType) for f in table.schema])
    b = read_back(windows(table.unionByName(extra)))
    turn_text = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss_text = F.array_join("loss", "")
    return b.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turn_text, 256).alias("turns_sha256"),
        F.length(loss_text).cast("long").alias("loss_chars"),
        F.sha2(loss_text, 256).alias("loss_sha256"),
        "formatted_chars",
        "n_windows",
        "max_tokens",
    )


OP4_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 4 AS cost,
         length(replace(replace(text, '\', '\b'), '<', '\l')) + length(replace(replace(replace(role, '\', '\b'), '<', '\l'), chr(10), '\n')) + 15 AS chars FROM c),
r AS (SELECT *, min(CASE WHEN role = 'system' THEN i END) OVER (PARTITION BY conv_id) AS sys FROM t),
o AS (SELECT *, CASE WHEN i = sys THEN 0 ELSE cost END AS own, greatest(0, 512 - coalesce(max(CASE WHEN i = sys THEN cost END) OVER (PARTITION BY conv_id), 0)) AS room FROM r),
s AS (SELECT *, sum(own) OVER (PARTITION BY conv_id ORDER BY i) - own AS start, greatest(1, (room - least(128, room // 4)) // 2) AS half FROM o),
f AS (SELECT *, i = 1 OR start // half <> lag(start // half) OVER w OR own > half OR lag(own) OVER w > half AS first FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
g AS (SELECT *, sum(first::INT) OVER (PARTITION BY conv_id ORDER BY i) - 1 AS win FROM f),
wn AS (SELECT conv_id, win, min(start) AS wstart, sum(own) AS span, any_value(room) AS room, any_value(sys) AS sys, sum(cost) AS cost, least(128, greatest(0, any_value(room) - sum(own))) AS past FROM g GROUP BY conv_id, win),
h AS (SELECT wn.conv_id, wn.win, g.chars, g.cost FROM wn JOIN g ON g.conv_id IS NOT DISTINCT FROM wn.conv_id AND g.win < wn.win AND g.i IS DISTINCT FROM wn.sys AND wn.wstart - g.start BETWEEN 1 AND wn.past
      UNION ALL SELECT wn.conv_id, wn.win, g.chars, g.cost FROM wn JOIN g ON g.conv_id IS NOT DISTINCT FROM wn.conv_id AND g.i = wn.sys AND g.win <> wn.win),
k AS (SELECT wn.conv_id, wn.win, any_value(wn.cost) + coalesce(sum(h.cost), 0) AS tokens, coalesce(sum(h.chars), 0) AS n FROM wn LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM wn.conv_id AND h.win = wn.win GROUP BY wn.conv_id, wn.win),
e AS (SELECT conv_id, sum(n) AS n, count(*) AS windows, max(tokens) AS tokens FROM k GROUP BY conv_id)
SELECT g.conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(chars) + max(e.n))::BIGINT AS formatted_chars, max(e.windows)::BIGINT AS n_windows, max(e.tokens)::BIGINT AS max_tokens
FROM g JOIN e ON e.conv_id IS NOT DISTINCT FROM g.conv_id GROUP BY g.conv_id
"""
