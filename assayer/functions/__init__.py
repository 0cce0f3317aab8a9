"""Column expressions: no shuffle, no state, usable in batch and streams."""
