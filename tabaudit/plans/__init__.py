"""Declared comparisons and the end-to-end run."""
