"""Operators for large training-text corpora: one module per operator, queries in registry."""
