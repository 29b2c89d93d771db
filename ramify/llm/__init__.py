"""Operators for large text-corpus preparation; nothing else in the package imports them."""
