"""The monitor on Structured Streaming."""
