"""operators of the position engine."""
