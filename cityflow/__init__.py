"""Hourly demand analytics as Spark jobs: ingest, mart, analytics, features, models, drift."""
