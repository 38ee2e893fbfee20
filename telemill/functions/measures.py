"""Numeric expressions of the latency and throughput measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from telemill.schemas import BUCKETS


def seconds(nanoseconds) -> Column:
    return F.coalesce(nanoseconds, F.lit(0)) / F.lit(1e9)


def per_second(count, secs) -> Column:
    """count / secs, null unless secs is positive."""
    return F.when(secs > 0, count / secs)


def clamp_min(value, least: float) -> Column:
    """The larger of the two; null stays null."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(least)))


def finite(value) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def queue_seconds(ttft, load_ns, prompt_ns, has_load, has_prompt) -> Column:
    """Waiting before work began: what of the first-token time is neither loading nor prompt reading; null unless all three are known."""
    return F.when(ttft.isNotNull() & has_load & has_prompt, F.greatest(ttft - seconds(load_ns) - seconds(prompt_ns), F.lit(0.0)))


def bucket_counts(value) -> Column:
    """Cumulative counts at each bound, in one aggregate pass and without a cross product."""
    return F.array(*[F.count_if(value <= b) for b in BUCKETS])


def generation_rates(prompt_tokens, prompt_s, output_tokens, decode_s, wall_s, ttft) -> dict[str, Column]:
    """The four rates of one generation."""
    return {
        "prompt_tokens_per_second": per_second(prompt_tokens, prompt_s),
        "decode_tokens_per_second": per_second(output_tokens, decode_s),
        "wall_tokens_per_second_after_first_token": per_second(F.greatest(output_tokens - 1, F.lit(0)), wall_s - ttft),
        "end_to_end_tokens_per_second": per_second(output_tokens, wall_s),
    }


#: What a value is multiplied by for a panel's unit.
UNITS = {"": 1.0, "percent": 100.0, "kib": 2.0**-10, "mib": 2.0**-20, "gib": 2.0**-30, "ms": 1000.0}


def scaled(value, unit: str) -> Column:
    """A value in a panel's unit; an unknown unit is an error."""
    return value * F.lit(UNITS[unit])


def offload_percent(vram, size) -> Column:
    return vram / F.nullif(size, F.lit(0)) * 100


def fully_offloaded(vram, size) -> Column:
    return (F.coalesce(size, F.lit(0)) != 0) & vram.eqNullSafe(size)


def banded(value, steps: list[tuple[float | None, str]]) -> Column:
    """The name of the highest step not above the value; a step of None is the floor."""
    out = F.lit(next((name for at, name in steps if at is None), None))
    for at, name in sorted((s for s in steps if s[0] is not None), key=lambda s: s[0]):
        out = F.when(value >= at, name).otherwise(out)
    return F.when(value.isNotNull(), out)
