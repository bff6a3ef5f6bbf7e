"""Column functions usable in batch and streaming."""
