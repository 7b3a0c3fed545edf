"""sources of the position engine."""
