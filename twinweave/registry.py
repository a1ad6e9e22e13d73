"""Registered queries of the core library and their DuckDB SQL, by name."""

from __future__ import annotations

from twinweave.queries import QUERIES, SQL, detection, files, history, lookups, reports, scalars, streams

__all__ = ["FLAGSHIP", "QUERIES", "SQL", "detection", "files", "history", "lookups", "reports", "scalars", "streams"]

FLAGSHIP = "flagship_exact_duplicates"
