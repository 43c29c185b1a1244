"""Spark-first catalogue analytics: streaming."""
