"""Queries and SQL of the problems tagged llm."""

from importlib import import_module

MODULES = ["frequency", "markup", "overlap", "distinctive", "topn", "packing", "mixing", "truncated"]


def _all(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(import_module(f"lexweave.llm.{name}"), what)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("SQL")
