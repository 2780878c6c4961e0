"""Feeds and pages to typed tables, tables to files."""
