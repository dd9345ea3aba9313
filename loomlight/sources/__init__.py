"""Sources of the span analytics engine."""
