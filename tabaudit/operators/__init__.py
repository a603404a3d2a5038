"""Operators: cleaning, audit, profile, model preparation, evaluation and report."""
