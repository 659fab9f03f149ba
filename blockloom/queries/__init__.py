"""Named queries over the test tables, each with DuckDB SQL for the same rows."""

from blockloom.queries import audits, checked, documents, grids, numbers, phrases, sequences
from blockloom.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "audits", "checked", "documents", "grids", "numbers", "phrases", "sequences"]
