"""Change feeds as Structured Streaming queries."""
