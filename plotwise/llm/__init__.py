"""Operators of a training-data pipeline over the corpus tables."""
