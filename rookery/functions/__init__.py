"""functions of the position engine."""
