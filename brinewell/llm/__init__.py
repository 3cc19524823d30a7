"""Operators for training text and for matching by learned or collective methods. Nothing outside imports this package."""
