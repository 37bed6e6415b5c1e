"""Column builders and pure value functions."""
