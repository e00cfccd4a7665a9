"""Camera-traffic analytics as plain Spark DataFrame jobs."""
