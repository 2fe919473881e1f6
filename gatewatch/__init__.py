"""Sign-in log analytics as Spark DataFrame jobs."""
