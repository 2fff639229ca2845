"""Queries over the driver's tables, each made of the library's operators."""
