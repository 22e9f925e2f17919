"""Operators for large text and identifier collections; nothing outside this package imports it."""
