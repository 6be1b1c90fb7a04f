"""Readers and writers for entity tables, robots and sitemap files."""
