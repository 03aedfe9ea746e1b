"""Operators for preparing training text: deduplication, filters, scans, mixing and encoding."""
