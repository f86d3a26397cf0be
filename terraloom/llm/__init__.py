"""Operators for preparing training text at scale: screening, de-duplication, scoring, mixing and encoding."""
