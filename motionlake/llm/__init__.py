"""Operators for preparing training text: mixing, packing, search, privacy, filters, duplicates."""
