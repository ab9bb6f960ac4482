"""Schemas, nested thread pages, warehouse access and the views derived from the given tables."""
