"""noteproof.streaming."""
