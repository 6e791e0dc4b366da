"""operators of the trace library."""
