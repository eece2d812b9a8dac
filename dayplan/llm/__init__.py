"""Operators for preparing training text: archives, filters, deduplication, mixing, tokens."""
