"""Operators of a training-data pipeline over documents and pages; ``queries`` registers one query for each."""
