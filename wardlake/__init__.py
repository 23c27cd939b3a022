"""Security-telemetry analytics written as Spark DataFrame jobs."""
