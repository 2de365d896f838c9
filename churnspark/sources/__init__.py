"""Readers, writers and the books derived from the star tables."""
