"""Operators for preparing training data at scale (search, models, filters, deduplication)."""
