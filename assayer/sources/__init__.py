"""Readers with fixed schemas and writers."""
