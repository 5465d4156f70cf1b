"""Operators for training-data corpora."""
