"""Readers, writers and record extraction."""
