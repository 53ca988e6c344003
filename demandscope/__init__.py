"""Search-demand analytics as Spark DataFrame jobs."""
