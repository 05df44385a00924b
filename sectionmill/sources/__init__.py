"""Readers: contents trees, seeds, pages, finished records."""
