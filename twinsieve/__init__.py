"""Spark-first entity resolution and duplicate analytics."""
