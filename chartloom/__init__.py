"""Clinical-record field analytics as Spark DataFrame jobs."""
