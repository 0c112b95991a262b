"""Event-time operators for Structured Streaming."""
