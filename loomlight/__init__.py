"""Loomlight: agent-run telemetry analytics on PySpark."""
