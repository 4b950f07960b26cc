"""Live jobs on Structured Streaming; each uses the batch operators unchanged."""
