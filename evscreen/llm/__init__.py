"""Operators of a training-data pipeline: ten corpus-scale filters, searches and deduplicators."""
