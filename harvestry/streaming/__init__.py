"""The same row pipeline over message streams."""
