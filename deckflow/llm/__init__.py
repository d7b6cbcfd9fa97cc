"""Operators of a training-data pipeline over one table of documents."""
