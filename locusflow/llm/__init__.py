"""Operators of a training-data pipeline over document, page, vector and conversation tables."""
