"""Operators for preparing training text: stores, scans, deduplication, scoring and packing."""
