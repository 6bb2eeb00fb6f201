"""Operators on training texts and their records. Nothing outside this package imports it."""
