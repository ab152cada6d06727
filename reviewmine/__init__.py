"""reviewmine: review and interaction mining as plain Spark DataFrame jobs."""
