"""Readers, writers and typed schemas."""
