"""Column expressions and ranking metrics."""
