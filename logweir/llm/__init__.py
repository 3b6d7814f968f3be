"""Operators for the preparation of training data, and their queries."""
