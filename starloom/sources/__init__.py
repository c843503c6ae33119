"""Schemas, readers and the versioned store of published tables."""
