"""Column expressions: vectors, text, metrics, images and wire formats."""
