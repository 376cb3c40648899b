"""Readers, provider contracts and caches."""
