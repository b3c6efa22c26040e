"""Whole-crawl jobs composed from the operators."""
