"""Binds the library to the driver tables: named queries and their SQL checks."""
