"""Operators for large-scale training-data preparation. Nothing outside imports this."""
