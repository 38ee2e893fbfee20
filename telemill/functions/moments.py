"""Times, identifiers and change keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def moment(epoch_seconds) -> Column:
    return F.timestamp_micros(F.round(epoch_seconds * 1e6).cast("bigint"))


def iso_utc(ts) -> Column:
    """With a UTC session."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def new_id() -> Column:
    """A random identifier of 32 hex digits."""
    return F.replace(F.uuid(), F.lit("-"), F.lit(""))


def change_key(identifier, state, duration, response) -> Column:
    """Differs when a record's page would: id, state, duration, length of the response, colon-joined; nulls as ''."""
    blank = F.lit("")
    return F.concat_ws(":", identifier, F.coalesce(state, blank), F.coalesce(duration.cast("string"), blank), F.length(F.coalesce(response, blank)).cast("string"))


def legend(template: str, *names: str) -> Column:
    """A template whose {{name}} are filled from columns; null is ''."""
    out = F.lit(template)
    for n in names:
        out = F.replace(out, F.lit("{{" + n + "}}"), F.coalesce(F.col(n).cast("string"), F.lit("")))
    return out
