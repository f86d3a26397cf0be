"""Imports every module that registers a query."""

from terraloom.llm import collocations, context_mixing, decontam, exact_dedup, line_dedup, mixing, near_dedup, pii, quality, sharding, spelling, token_counts, token_files  # noqa: F401
from terraloom.llm.registry import ORACLES, QUERIES  # noqa: F401
