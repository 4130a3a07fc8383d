"""Operators that turn a document corpus into training data. Nothing else in the library imports this."""
