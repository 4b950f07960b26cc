"""Market-tape analytics as Spark DataFrame jobs."""
