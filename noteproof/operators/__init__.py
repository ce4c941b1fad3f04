"""noteproof.operators."""
