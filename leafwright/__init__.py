"""Leafwright: rule-leaf extraction, verification and evaluation as Spark jobs."""
