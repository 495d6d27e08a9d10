"""Registered queries: each applies library operators to relations derived from the driver's tables."""
