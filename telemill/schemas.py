"""Explicit read schemas: no scan infers types."""

from __future__ import annotations

from pyspark.sql import types as T

INVOCATION = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("started", T.DoubleType(), False),
        T.StructField("model", T.StringType()),
        T.StructField("endpoint", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("purpose", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("ttft", T.DoubleType()),
        T.StructField("prompt_tokens", T.LongType()),
        T.StructField("generated_tokens", T.LongType()),
        T.StructField("request", T.StringType()),
        T.StructField("response", T.StringType()),
        T.StructField("truncated", T.BooleanType()),
        T.StructField("error", T.StringType()),
    ]
)

SAMPLE = T.StructType(
    [
        T.StructField("metric", T.StringType()),
        T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
        T.StructField("ts", T.TimestampType()),
        T.StructField("value", T.DoubleType()),
    ]
)

STREAM_LINE = T.StructType([T.StructField("id", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("line", T.StringType())])

#: Bounds of the latency histograms, in seconds. Fixed values.
BUCKETS = (0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0)
#: Requests to these paths are recorded. Fixed values.
TRACKED = ("/api/chat", "/api/generate", "/api/embed", "/api/embeddings", "/v1/chat/completions", "/v1/completions", "/v1/embeddings", "/v1/responses")
#: Endpoints whose streams must end with a completion marker. Fixed values.
MARKED = ("/api/chat", "/api/generate", "/v1/chat/completions", "/v1/completions")
