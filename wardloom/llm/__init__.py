"""Operators for training-data pipelines over texts and vectors; nothing outside imports this package."""
