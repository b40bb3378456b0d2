"""Readers and builders of the engine's tables."""
