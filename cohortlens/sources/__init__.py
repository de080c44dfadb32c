"""Readers, writers and role tables."""
