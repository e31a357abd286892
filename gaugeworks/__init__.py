"""Metered telemetry analytics on Spark."""
