"""Demand analytics as Spark jobs: rollups, features, audits, models and metrics over hourly tables."""
