"""Readers for sequence and annotation files, and the writers of results."""
