"""Operators of a training-data pipeline on the text, page and vector tables."""
