"""Operators of a training-data pipeline over documents, lines, tokens and vectors."""
