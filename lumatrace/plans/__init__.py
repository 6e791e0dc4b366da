"""plans of the trace library."""
