"""All registered queries of the library outside quillon.llm: name -> query, name -> DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its inventory name, with the SQL that must give the same rows."""

    def add(f: Query) -> Query:
        _queries[name] = f
        if sql is not None:
            _sql[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    _load()
    return _queries


def oracle_sql() -> dict[str, str]:
    _load()
    return _sql


def _load() -> None:
    """Imports the modules whose queries register themselves."""
    from .plans import answering, assembling, briefing, controlling, curating, looping, measure, naming, rewriting, sampled, selecting, streamed, studying  # noqa: F401
