"""operators of the equity engine."""
