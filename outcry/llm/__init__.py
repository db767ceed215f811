"""Operators for preparing training text at scale: search, counting, deduplication, filtering, extraction, packing, output."""
