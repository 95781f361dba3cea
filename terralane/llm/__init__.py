"""Operators for text corpora that become training data."""
