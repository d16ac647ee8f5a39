"""Retrieval, temporal-grounding and corpus analytics as PySpark DataFrame pipelines."""

__version__ = "0.1.0"
