"""plans of the position engine."""
