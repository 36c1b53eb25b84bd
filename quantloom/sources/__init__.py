"""sources of the equity engine."""
