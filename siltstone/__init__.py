"""Spark-first analytics over complaint-style feeds: ingest, sampling, scoring and drift."""
