"""Spark-first catalogue analytics: functions."""
