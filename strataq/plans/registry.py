"""All queries by name, with their oracles in DuckDB SQL."""

from __future__ import annotations

from . import artifacts, lookups
from .queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "artifacts", "lookups"]
