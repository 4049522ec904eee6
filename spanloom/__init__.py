"""Agent-telemetry analytics as Spark DataFrame operators."""
