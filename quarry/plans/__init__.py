"""Whole plans: compilation of sources, and programs made from tables."""
