"""Readers of text formats into long tables, and writers."""
