"""Text expressions with the semantics of the history search and the answer scorers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c) -> Column:
    """Folds A-Z only: other letters keep their case."""
    return F.translate(c, UPPER, LOWER)


def or_blank(*cs) -> Column:
    """The first value that is neither null nor '' (null if there is none)."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cs])


def contains_literal(haystack, needle: str) -> Column:
    """Case-insensitive (ASCII) literal containment; a null haystack never matches."""
    return F.instr(ascii_lower(haystack), F.lit(needle.translate(str.maketrans(UPPER, LOWER)))) > 0


def metric_label(c) -> Column:
    r"""Escapes backslash, then line feed, then double quote."""
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit('"'), F.lit('\\"'))


def full_match(c, pattern: str) -> Column:
    """A label matcher: the expression must match the whole value (null counts as '')."""
    return F.coalesce(c, F.lit("")).rlike(rf"\A(?:{pattern})\z")


def clipped_bytes(c, limit: int) -> Column:
    """The first `limit` bytes as text, a cut character replaced."""
    return F.make_valid_utf8(F.substring(c.cast("binary"), 1, limit).cast("string"))


def normalized_answer(c) -> Column:
    """Trimmed, white space squeezed, lower-cased, without a leading 'answer:', outer quotes and one final dot."""
    x = F.regexp_replace(F.regexp_replace(c, r"(?U)\A\s+|\s+\z", ""), r"(?U)\s+", " ")
    x = F.regexp_replace(F.lower(x), r"\Aanswer\s*:\s*", "")
    x = F.regexp_replace(x, r"""\A[ \t\r\n"']+|[ \t\r\n"']+\z""", "")
    return F.regexp_replace(x, r"\.\z", "")


def stripped(c) -> Column:
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def numeric_answer(c) -> Column:
    """The number that is the whole answer (commas dropped, optional 'answer:', one final . or !), else null."""
    x = F.replace(stripped(c), F.lit(","), F.lit(""))
    got = F.regexp_extract(x, r"(?i)\A(?:answer\s*:\s*)?([-+]?\d+(?:\.\d+)?)[.!]?\z", 1)
    return F.nullif(got, F.lit("")).try_cast("decimal(38,10)")


def json_equal(left, right) -> Column:
    """Deep equality of JSON texts, key order ignored; null if the left is not JSON."""
    canon = lambda c: F.to_json(F.try_parse_json(c))  # noqa: E731  variant objects print their keys in order
    return canon(left) == canon(right)
