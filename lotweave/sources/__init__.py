"""Readers, sinks and lookup tables."""
