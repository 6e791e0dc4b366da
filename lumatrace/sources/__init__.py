"""sources of the trace library."""
