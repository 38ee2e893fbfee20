"""Dashboard panels as data, evaluated over one samples table at an instant or at each step of a range.

Samples: (metric, labels map, ts, value). A panel names a shape and its metrics;
panels that differ only in how they are drawn share an entry.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.functions.measures import clamp_min
from telemill.functions.text import full_match
from telemill.operators import timeseries

WINDOW = 300


@dataclass(frozen=True)
class Panel:
    """shape: instant, rate, quantile, ratio, rest, difference, busy, per_cpu, load_cost, errors, up or age (see evaluate)."""

    title: str
    shape: str
    metric: str
    other: str = ""
    by: tuple[str, ...] = ()
    where: dict[str, tuple[str, str]] = field(default_factory=dict)
    q: float = 0.0
    unit: str = ""


_ROOT = {"mountpoint": ("=", "/")}
_IDLE = {"mode": ("=", "idle")}
_DISKS = {"device": ("=~", r"nvme.*|sd.*|vd.*|xvd.*|hd.*|mmcblk.*")}
_LINKS = {"device": ("!~", r"^(lo|veth|br-|docker|tun|cni|flannel|virbr)")}
_BAD = {"status": ("!~", "2..")}

#: Metric names, label matchers and quantiles are fixed values.
PANELS = (
    Panel("Ollama probe", "instant", "probe_success"),
    Panel("VRAM used", "instant", "nvidia_smi_memory_used_bytes"),
    Panel("VRAM total", "instant", "nvidia_smi_memory_total_bytes"),
    Panel("GPU utilization", "instant", "nvidia_smi_utilization_gpu_ratio"),
    Panel("GPU power", "instant", "nvidia_smi_power_draw_watts"),
    Panel("GPU power limit", "instant", "nvidia_smi_power_limit_watts"),
    Panel("GPU temperature", "instant", "nvidia_smi_temperature_gpu"),
    Panel("GPU clock", "instant", "nvidia_smi_clocks_current_graphics_clock_hz"),
    Panel("Disk free bytes", "instant", "node_filesystem_avail_bytes", where=_ROOT),
    Panel("Host CPU", "busy", "node_cpu_seconds_total", where=_IDLE),
    Panel("Host memory", "rest", "node_memory_MemAvailable_bytes", "node_memory_MemTotal_bytes"),
    Panel("Ollama up", "instant", "ollama_up"),
    Panel("Version", "instant", "ollama_version_info", by=("version",)),
    Panel("Active", "instant", "ollama_active_requests"),
    Panel("Request rate", "rate", "ollama_requests_total"),
    Panel("Error share", "errors", "ollama_requests_total"),
    Panel("Prompt volume", "rate", "ollama_prompt_tokens_total"),
    Panel("Output volume", "rate", "ollama_generated_tokens_total"),
    Panel("Last decode", "instant", "ollama_last_decode_tokens_per_second", by=("model",)),
    Panel("Last prompt", "instant", "ollama_last_prompt_tokens_per_second", by=("model",)),
    Panel("p95 queue", "quantile", "ollama_queue_duration_seconds_bucket", q=0.95),
    Panel("p95 duration", "quantile", "ollama_request_duration_seconds_bucket", q=0.95),
    Panel("p50 first token", "quantile", "ollama_time_to_first_token_seconds_bucket", q=0.50),
    Panel("p95 first token", "quantile", "ollama_time_to_first_token_seconds_bucket", q=0.95),
    Panel("GPU resident", "ratio", "ollama_model_vram_bytes", "ollama_model_size_bytes", by=("model",)),
    Panel("Offloaded", "rest", "ollama_model_vram_bytes", "ollama_model_size_bytes", by=("model",)),
    Panel("Request rate by model", "rate", "ollama_requests_total", by=("model",)),
    Panel("Failure rate by model", "rate", "ollama_requests_total", by=("model",), where=_BAD),
    Panel("Prompt rate by model", "rate", "ollama_prompt_tokens_total", by=("model",)),
    Panel("Output rate by model", "rate", "ollama_generated_tokens_total", by=("model",)),
    Panel("p50 duration by model", "quantile", "ollama_request_duration_seconds_bucket", by=("model",), q=0.50),
    Panel("p95 duration by model", "quantile", "ollama_request_duration_seconds_bucket", by=("model",), q=0.95),
    Panel("p50 first token by model", "quantile", "ollama_time_to_first_token_seconds_bucket", by=("model",), q=0.50),
    Panel("p95 first token by model", "quantile", "ollama_time_to_first_token_seconds_bucket", by=("model",), q=0.95),
    Panel("p95 queue by model", "quantile", "ollama_queue_duration_seconds_bucket", by=("model",), q=0.95),
    Panel("Loaded", "instant", "ollama_model_loaded", by=("model",)),
    Panel("Model size", "instant", "ollama_model_size_bytes", by=("model",)),
    Panel("Model VRAM", "instant", "ollama_model_vram_bytes", by=("model",)),
    Panel("Context length", "instant", "ollama_model_context_length", by=("model",)),
    Panel("Load cost", "load_cost", "ollama_model_load_seconds_total", "ollama_requests_total", by=("model",)),
    Panel("Uptime", "age", "node_boot_time_seconds"),
    Panel("Root disk free", "ratio", "node_filesystem_avail_bytes", "node_filesystem_size_bytes", where=_ROOT),
    Panel("Root disk used", "rest", "node_filesystem_avail_bytes", "node_filesystem_size_bytes", where=_ROOT),
    Panel("Load 1 a CPU", "per_cpu", "node_load1", "node_cpu_seconds_total", where=_IDLE),
    Panel("Load 5 a CPU", "per_cpu", "node_load5", "node_cpu_seconds_total", where=_IDLE),
    Panel("Load 15 a CPU", "per_cpu", "node_load15", "node_cpu_seconds_total", where=_IDLE),
    Panel("Targets healthy", "up", "up"),
    Panel("VRAM share", "ratio", "nvidia_smi_memory_used_bytes", "nvidia_smi_memory_total_bytes"),
    Panel("RAM used", "difference", "node_memory_MemTotal_bytes", "node_memory_MemAvailable_bytes"),
    Panel("RAM total", "instant", "node_memory_MemTotal_bytes"),
    Panel("Swap used", "difference", "node_memory_SwapTotal_bytes", "node_memory_SwapFree_bytes"),
    Panel("Swap total", "instant", "node_memory_SwapTotal_bytes"),
    Panel("Disk read", "rate", "node_disk_read_bytes_total", by=("device",), where=_DISKS),
    Panel("Disk written", "rate", "node_disk_written_bytes_total", by=("device",), where=_DISKS),
    Panel("Network received", "rate", "node_network_receive_bytes_total", by=("device",), where=_LINKS),
    Panel("Network sent", "rate", "node_network_transmit_bytes_total", by=("device",), where=_LINKS),
)


def _pick(samples: DataFrame, metric: str, where: dict, by: tuple[str, ...] = ()) -> DataFrame:
    """Samples of a metric with `series`, two hashes of the label map in order of its keys, and the labels that a panel goes by (empty if absent)."""
    s = samples.filter(F.col("metric") == metric)
    label = lambda name: F.coalesce(F.get(F.array(F.try_element_at("labels", F.lit(name))), F.lit(0)), F.lit(""))
    for name, (op, value) in where.items():
        c = label(name)
        s = s.filter({"=": c == value, "=~": full_match(c, value), "!~": ~full_match(c, value)}[op])
    entries = F.array_sort(F.map_entries("labels"))
    series = F.struct(F.xxhash64(entries).alias("a"), F.xxhash64(F.lit("series"), entries).alias("b"))
    return s.select(series.alias("series"), *[label(b).alias(b) for b in by], "ts", "value")


@dataclass(frozen=True)
class _Clock:
    """How a panel is seen: at an instant, or at each step of a range, whose time is then the column `at`."""

    at: str
    start: str = ""
    step: int = 0

    @property
    def keys(self) -> tuple[str, ...]:
        return ("at",) if self.step else ()

    def now(self, samples: DataFrame, by: tuple[str, ...]) -> DataFrame:
        keys = ("series", *by)
        return timeseries.step_grid(samples, self.start, self.at, self.step, keys) if self.step else timeseries.instant(samples, self.at, keys)

    def rates(self, samples: DataFrame, by: tuple[str, ...]) -> DataFrame:
        keys = ("series", *by)
        return timeseries.rate_grid(samples, self.start, self.at, self.step, WINDOW, keys) if self.step else timeseries.rate(samples, self.at, WINDOW, keys)

    def seconds(self):
        return F.unix_micros("at" if self.step else timeseries.at_time(self.at)) / 1e6


def evaluate(panel: Panel, samples: DataFrame, at: str) -> DataFrame:
    """(by..., value) of a panel at an instant. Divisors have the panels' usual floors: 1, or 0.001 requests a second."""
    return _evaluate(panel, samples, _Clock(at))


def evaluate_range(panel: Panel, samples: DataFrame, start: str, end: str, step: int) -> DataFrame:
    """(at, by..., value) of a panel at each step (seconds) from start to end, in one pass over the samples of each metric."""
    return _evaluate(panel, samples, _Clock(end, start, step))


def _evaluate(panel: Panel, samples: DataFrame, clock: _Clock) -> DataFrame:
    by, t = panel.by, clock.keys
    own = lambda *labels: _pick(samples, panel.metric, panel.where, (*by, *labels))
    other = lambda labels=(), where=panel.where: _pick(samples, panel.other, where, labels)
    summed = lambda v, *labels: v.groupBy(*t, *labels).agg(F.sum("value").alias("value"))
    if panel.shape == "instant":
        return clock.now(own(), by).select(*t, *by, "value")
    if panel.shape == "rate":
        return summed(clock.rates(own(), by), *by)
    if panel.shape == "errors":
        return timeseries.error_ratio(clock.rates(own("status"), ("status",)), 0.001, *t)
    if panel.shape == "quantile":
        v = clock.rates(own("le"), (*by, "le")).withColumn("le", F.when(F.col("le") == "+Inf", float("inf")).otherwise(F.col("le").try_cast("double")))
        return timeseries.histogram_quantile(summed(v, *by, "le"), panel.q, *t, *by)
    if panel.shape == "busy":
        return clock.rates(own(), ()).groupBy(*t).agg((1 - F.avg("value")).alias("value"))
    if panel.shape == "age":
        return clock.now(own(), ()).select(*t, (clock.seconds() - F.col("value")).alias("value"))
    if panel.shape == "up":
        return clock.now(own(), ()).groupBy(*t).agg((F.sum("value") / F.greatest(F.count("value"), F.lit(1))).alias("value"))
    if panel.shape == "load_cost":  # joined on the model, as the two sides' other labels differ
        asked = summed(clock.rates(other(by, {}), by), *by)
        return timeseries.ratio(summed(clock.rates(own(), by), *by), asked, (*t, *by), 0.001)
    if panel.shape == "per_cpu":  # one row of CPUs a time, whatever the labels
        cpus = clock.now(other(), ()).groupBy(*t).agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n"))
        load = clock.now(_pick(samples, panel.metric, {}), ())
        return (load.join(cpus, list(t)) if t else load.crossJoin(cpus)).select(*t, (F.col("value") / F.col("n")).alias("value"))
    right = clock.now(other(), ()).select("series", *t, F.col("value").alias("_d"))
    both = clock.now(own(), by).join(right, ["series", *t])
    value = {
        "ratio": F.col("value") / clamp_min(F.col("_d"), 1.0),
        "rest": 1 - F.col("value") / clamp_min(F.col("_d"), 1.0),
        "difference": F.col("value") - F.col("_d"),
    }[panel.shape]
    return both.select(*t, *by, value.alias("value"))
