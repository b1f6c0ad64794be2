"""Operators that prepare training text at scale."""
