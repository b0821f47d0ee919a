"""Operators for preparing training data: one module for each, queries and their SQL in ``catalog``."""
