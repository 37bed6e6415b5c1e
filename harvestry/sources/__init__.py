"""Readers of captured content: HTML, JSON in pages, message frames, request logs."""
