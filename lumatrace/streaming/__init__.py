"""streaming of the trace library."""
