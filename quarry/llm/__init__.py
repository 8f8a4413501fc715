"""Operators for preparing training data, one module each; queries and SQL are in queries.py."""
