"""Time-to-event cohort analytics as Spark DataFrame jobs."""
