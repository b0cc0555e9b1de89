"""Operators on the text and identity of training data. Nothing outside imports this package."""
