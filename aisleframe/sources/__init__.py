"""Readers, writers and the small records kept beside each table."""
