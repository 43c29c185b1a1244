"""Spark-first catalogue analytics: operators."""
