"""The alert rules as data: a condition over named vectors, held for a time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """`condition` is SQL over the columns of a frame of the rule's inputs at each ts; summary may name its labels in braces. where: matchers on labels that the frame has."""

    name: str
    inputs: tuple[str, ...]
    condition: str
    hold_seconds: int
    severity: str
    summary: str
    where: tuple[tuple[str, str, str], ...] = ()


#: Thresholds, hold times and severities are fixed values.
RULES = (
    Rule("OllamaNotAnswering", ("probe_success",), "probe_success = 0", 120, "critical", "the model server does not answer"),
    Rule("OllamaMetricsProxyDown", ("up",), "up = 0", 120, "critical", "the metrics proxy is down", (("job", "=", "ollama"),)),
    Rule("ModelPartiallyOffloaded", ("size", "vram"), "size > 0 and vram / size < 0.99", 120, "warning", "{model} is not wholly in video memory"),
    Rule("OllamaHighErrorRate", ("bad_rate", "rate"), "bad_rate / greatest(rate, 0.001) > 0.10", 300, "warning", "more than a tenth of requests fail"),
    Rule("OllamaRequestQueueBacklog", ("active_requests",), "active_requests > 1", 30, "warning", "requests wait"),
    Rule("ObservabilityComponentDown", ("up",), "up = 0", 300, "warning", "{job} is down", (("job", "=~", "prometheus|loki|alloy|gpu|node|blackbox"),)),
    Rule("OpenWebUINotAnswering", ("probe_success",), "probe_success = 0", 300, "warning", "the web interface does not answer"),
    Rule("GpuMemoryNearlyFull", ("used", "total"), "used / greatest(total, 1) > 0.95", 300, "warning", "video memory is nearly full"),
    Rule("GpuSustainedHighTemperature", ("temperature",), "temperature > 85", 600, "warning", "the card is hot"),
    Rule("ModelDiskNearlyFull", ("avail", "size"), "avail / greatest(size, 1) < 0.10", 900, "warning", "the disk is nearly full"),
    Rule("HostMemoryNearlyExhausted", ("available", "total"), "available / greatest(total, 1) < 0.10", 600, "warning", "memory is nearly exhausted"),
)


def evaluate(rule: Rule, inputs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(alert, severity, keys, since, until, fired_at, summary) from a frame with keys, ts and the rule's input columns."""
    from telemill.operators.timeseries import alerts, matched

    for label, op, value in rule.where:
        inputs = matched(inputs, **{label: (op, value)})
    c = inputs.withColumn("firing", F.coalesce(F.expr(rule.condition), F.lit(False)))
    text = F.lit(rule.summary)
    for k in keys:
        text = F.replace(text, F.lit("{" + k + "}"), F.coalesce(F.col(k).cast("string"), F.lit("")))
    a = alerts(c, keys, rule.hold_seconds)
    return a.select(F.lit(rule.name).alias("alert"), F.lit(rule.severity).alias("severity"), *keys, "since", "until", "fired_at", text.alias("summary"))


__all__ = ["RULES", "Rule", "evaluate"]
