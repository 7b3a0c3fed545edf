"""streaming of the position engine."""
