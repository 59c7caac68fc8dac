"""Cohort-scale variant annotation and interpretation as Spark DataFrame jobs."""

__version__ = "0.1.0"
