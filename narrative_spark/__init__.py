"""Spark-first engine that turns long unstructured text into structured, evidence-backed profiles."""
