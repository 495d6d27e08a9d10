"""Readers, writers and the relations that the queries derive from the driver's tables."""
