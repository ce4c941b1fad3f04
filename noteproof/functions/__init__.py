"""noteproof.functions."""
