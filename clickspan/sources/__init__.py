"""Readers, writers and definition tables."""
