"""Operators for preparing training text: extraction, deduplication, filters, formatting, encoding."""
