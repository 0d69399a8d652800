"""Queries register themselves here with the SQL that must give the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}

#: Modules whose import registers queries.
MODULES: tuple[str, ...] = tuple(f"granary.plans.{m}" for m in ("listing", "metadata", "joins", "aggregates", "windows", "topk", "texts", "chunks", "retrieval", "times", "streams", "functions", "markdown", "candidates", "analysis", "qa", "table_rows", "hydration", "control", "layout", "web", "chat", "segmentation", "lexical_index", "files", "section_chunks", "families"))


def query(sql: str | None = None, name: str | None = None) -> Callable:
    """Registers a function (spark, sf_dir) -> DataFrame under its own name."""

    def register(f: Callable) -> Callable:
        key = name or f.__name__
        _QUERIES[key] = f
        if sql:
            _SQL[key] = sql
        return f

    return register


def collect() -> tuple[dict[str, Callable], dict[str, str]]:
    for module in MODULES:
        importlib.import_module(module)
    return dict(_QUERIES), dict(_SQL)
