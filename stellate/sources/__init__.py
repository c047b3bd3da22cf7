"""Databases of collections, and columnar files."""
