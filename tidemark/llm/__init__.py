"""Operators on training text: token ids, mixing of sources, subject areas. Nothing outside this package imports it."""
