"""Structured Streaming forms of the live views."""
