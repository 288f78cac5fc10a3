"""Operators of a training-data pipeline over tables of documents; nothing else in the library imports this package."""
