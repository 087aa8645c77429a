"""Mullion: dataset governance, duplicate search, reconciliation and model evaluation as PySpark plans."""
