"""Operators for building training data, and their registered queries."""
