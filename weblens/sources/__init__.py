"""Readers: result logs, stores, sitemaps, seed dumps."""
