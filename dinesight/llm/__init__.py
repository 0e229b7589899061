"""Operators for preparing training text: deduplication, quality, search, mixing, tokenisation."""
