"""Readers, writers and the source catalog."""
