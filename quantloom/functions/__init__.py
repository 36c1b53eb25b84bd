"""functions of the equity engine."""
