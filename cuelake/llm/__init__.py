"""Operators that prepare timed text as training data for language models. Nothing outside imports this package."""
