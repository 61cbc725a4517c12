"""Registered queries: each builds a plan over the shared tables."""
