"""noteproof.sources."""
