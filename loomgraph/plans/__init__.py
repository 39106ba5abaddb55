"""Schemas, join specifications and the plans built from them."""
