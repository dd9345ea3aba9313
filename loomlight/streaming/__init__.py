"""Streaming of the span analytics engine."""
