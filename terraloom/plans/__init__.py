"""Composed end-to-end analyses built from the operators."""
