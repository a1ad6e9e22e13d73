"""Registered queries, by the SURVEY row that each covers."""

from __future__ import annotations

QUERIES = {}
SQL = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir), with its DuckDB SQL if it has one."""

    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add
