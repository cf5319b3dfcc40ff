"""Column expressions: box geometry, masks as runs, text, and per-row scores."""
