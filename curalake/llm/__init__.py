"""Operators for training data: ten methods, their queries and their SQL. Nothing else in the library imports this."""
