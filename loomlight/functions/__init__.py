"""Functions of the span analytics engine."""
