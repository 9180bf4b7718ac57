"""Operators for training text: leaked evaluation items, mixing of sources, reading levels."""
