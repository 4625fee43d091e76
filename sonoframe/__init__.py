"""Interval and signal analytics over many recordings, as Spark DataFrame jobs."""
