"""Spark-first analytics over the telemetry of a model-serving host."""
