"""Deterministic audits of a translation against its source: finding tables and weighted scores."""
