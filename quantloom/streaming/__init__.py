"""streaming of the equity engine."""
