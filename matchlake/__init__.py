"""matchlake: sports-tracking analytics as Spark DataFrame jobs."""
