"""Server-sent events in batch and as a stateful Structured Streaming operator."""
