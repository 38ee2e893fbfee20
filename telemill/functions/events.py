"""Reading response events (schemaless JSON) as variants.

An event is opened once into a struct of the fields that matter; the expressions
below read that struct and look nothing up again.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOP = ("response", "thinking", "message", "choices", "done", "error", "usage", "object", "prompt_eval_count", "eval_count", "prompt_eval_duration", "eval_duration", "load_duration")
_MESSAGE = ("content", "thinking", "reasoning", "reasoning_content", "tool_calls")


def fields(v, names: tuple[str, ...]) -> Column:
    """A struct of the named fields as variants; null unless v is an object."""
    return F.try_variant_get(v, "$", "struct<" + ", ".join(f"{n}: variant" for n in names) + ">")


def is_object(v) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("")).startswith("OBJECT")


def as_text(v) -> Column:
    return F.try_variant_get(v, "$", "string")


def truthy(v) -> Column:
    """Neither absent, null, false, a zero, '' nor an empty list or object; the text "0" is something."""
    text = as_text(v)
    other = ~text.isin("false", "0", "0.0", "-0.0", "{}", "[]") & ~text.rlike(r"\A-?0+(?:\.0*)?(?:[eE].*)?\z")
    return F.coalesce(F.when(F.schema_of_variant(v) == "STRING", text != "").otherwise(other), F.lit(False))


def first_truthy(*vs) -> Column:
    return F.coalesce(*[F.when(truthy(v), as_text(v)) for v in vs])


def parsed(line) -> Column:
    """The JSON object of a stream line, with or without `data:`; null for blanks, [DONE], other JSON and non-JSON."""
    body = F.regexp_replace(F.regexp_replace(line, r"\A\s+|\s+\z", ""), r"\Adata:\s*", "")
    v = F.try_parse_json(body)
    return F.when(is_object(v), v)


def opened(df, event: str = "event"):
    """df with `x`: the event's fields `e`, its message `m`, its first choice `c` and that one's delta `d` and message `n`."""
    df = df.withColumn("_e", fields(F.col(event), _TOP))
    df = df.withColumn("_m", fields(F.col("_e.message"), _MESSAGE)).withColumn("_c", fields(F.try_variant_get("_e.choices", "$[0]", "variant"), ("delta", "message", "text")))
    df = df.withColumn("_d", fields(F.col("_c.delta"), _MESSAGE)).withColumn("_n", fields(F.col("_c.message"), _MESSAGE))
    return df.withColumn("x", F.struct(F.col("_e").alias("e"), F.col("_m").alias("m"), F.col("_c").alias("c"), F.col("_d").alias("d"), F.col("_n").alias("n"))).drop("_e", "_m", "_c", "_d", "_n")


def event_text(x) -> Column:
    """Text that an event adds; the first shape that applies decides, even with ''."""
    e, m, c, d, n = (x[k] for k in "emcdn")
    blank = F.lit("")
    said = lambda s: F.when(s.isNotNull(), F.coalesce(first_truthy(s["content"], s["reasoning"]), blank))
    from_choice = F.when(truthy(c["text"]), as_text(c["text"])).when(truthy(c["delta"]), said(d)).otherwise(said(n))
    rest = F.when(m.isNotNull(), F.coalesce(first_truthy(m["content"], m["thinking"]), blank)).otherwise(F.coalesce(first_truthy(e["response"], e["thinking"]), blank))
    return F.coalesce(F.when(c.isNotNull(), from_choice), rest)


def shown_content(x) -> Column:
    """Content as the detail page shows it; message, delta, choice message in that order."""
    return F.coalesce(_pick(x, ("content",)), first_truthy(x["e"]["response"], x["c"]["text"]), F.lit(""))


def shown_thinking(x) -> Column:
    return F.coalesce(_pick(x, ("thinking", "reasoning", "reasoning_content")), first_truthy(x["e"]["thinking"]), F.lit(""))


def _pick(x, names) -> Column:
    """From the first of the event's messages that is there."""
    homes = ((x["e"]["message"], x["m"]), (x["c"]["delta"], x["d"]), (x["c"]["message"], x["n"]))
    out = F.lit(None).cast("string")
    for raw, own in reversed(homes):
        out = F.when(own.isNotNull() | truthy(raw), first_truthy(*[own[f] for f in names])).otherwise(out)
    return out


def calls_tools(x) -> Column:
    """Whether the event's message, or any choice's delta or message, has tool calls."""
    choices = F.coalesce(F.try_variant_get(x["e"]["choices"], "$", "array<variant>"), F.array().cast("array<variant>"))
    in_choice = lambda c: truthy(F.try_variant_get(c, "$.delta.tool_calls", "variant")) | truthy(F.try_variant_get(c, "$.message.tool_calls", "variant"))
    return truthy(x["m"]["tool_calls"]) | F.exists(choices, in_choice)


def error_text(x) -> Column:
    """The event's error message, if it has one."""
    return F.when(truthy(x["e"]["error"]), as_text(x["e"]["error"]))


#: Fields of a measurement: column, key.
FIELDS = (
    ("prompt_tokens", "prompt_eval_count"),
    ("generated_tokens", "eval_count"),
    ("prompt_ns", "prompt_eval_duration"),
    ("eval_ns", "eval_duration"),
    ("load_ns", "load_duration"),
)


def final_measurement(x) -> Column:
    """struct(FIELDS, has_prompt_ns, has_eval_ns, has_load_ns, empty), or null if the event measures nothing. A key with a JSON null is there."""
    e = x["e"]
    number = lambda v: F.try_variant_get(v, "$", "bigint")
    own = F.struct(
        *[number(e[key]).alias(name) for name, key in FIELDS],
        *[e[key].isNotNull().alias(f"has_{name}") for name, key in FIELDS[2:]],
        F.lit(False).alias("empty"),
    )
    none, no = F.lit(None).cast("bigint"), F.lit(False)

    def bare(prompt, generated, empty):
        return F.struct(prompt.alias("prompt_tokens"), generated.alias("generated_tokens"), none.alias("prompt_ns"), none.alias("eval_ns"), none.alias("load_ns"), no.alias("has_prompt_ns"), no.alias("has_eval_ns"), no.alias("has_load_ns"), empty.alias("empty"))

    usage = fields(e["usage"], ("prompt_tokens", "completion_tokens"))
    return (
        F.when(truthy(e["done"]) | e["prompt_eval_count"].isNotNull(), own)
        .when(usage.isNotNull(), bare(number(usage["prompt_tokens"]), number(usage["completion_tokens"]), F.lit(False)))
        .when(as_text(e["object"]) == "chat.completion", bare(none, none, F.lit(True)))
    )
