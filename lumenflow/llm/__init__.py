"""Operations of a training-data pipeline. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from importlib import import_module

#: Modules that hold QUERIES and SQL.
MODULES = ("decontaminate", "licences", "secret_scan", "warc", "ppm", "topk_search", "mixing", "ngram_join", "chat_trees", "lang_id")


def _gather(what: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(import_module(f"{__name__}.{name}"), what)
    return found


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("SQL")
