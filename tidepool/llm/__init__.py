"""Operators that prepare training text and vectors; nothing outside this folder imports it."""
