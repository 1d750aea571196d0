"""Sessions, sources and sinks."""
