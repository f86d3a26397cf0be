"""Readers, catalogue searches and the provider registry."""
