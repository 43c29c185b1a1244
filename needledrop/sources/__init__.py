"""Spark-first catalogue analytics: sources."""
