"""Operators for training data made of text and code; nothing else in the library imports this."""
