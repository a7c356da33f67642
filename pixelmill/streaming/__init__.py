"""Frozen models on streams."""
