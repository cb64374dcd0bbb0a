"""Readers, writers and record shaping."""
