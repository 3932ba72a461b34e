"""Column-level building blocks (no DataFrames, no shuffles)."""
