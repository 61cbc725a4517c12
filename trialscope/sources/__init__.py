"""Readers of trace exports and gated artifacts."""
