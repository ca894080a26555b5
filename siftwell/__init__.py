"""Siftwell: dataset triage and training-data preparation on Apache Spark."""
