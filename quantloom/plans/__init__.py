"""plans of the equity engine."""
