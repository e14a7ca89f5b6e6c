"""Operators of a training-data pipeline over text corpora; nothing else in the package imports this."""
