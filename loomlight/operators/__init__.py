"""Operators of the span analytics engine."""
