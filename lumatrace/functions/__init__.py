"""functions of the trace library."""
