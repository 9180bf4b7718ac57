"""Change mirroring and labelled loads on Structured Streaming."""
