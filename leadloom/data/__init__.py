"""Bundled rule and keyword data."""
