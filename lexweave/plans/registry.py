"""Queries and SQL of the core."""

from importlib import import_module

MODULES = ["lexweave.plans.matrix", "lexweave.plans.headings", "lexweave.plans.texts", "lexweave.plans.relational", "lexweave.plans.latent", "lexweave.plans.sources", "lexweave.plans.tagging", "lexweave.plans.connectors", "lexweave.operators.rejects", "lexweave.operators.skew"]


def _all(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        own = getattr(import_module(name), what)
        out |= own() if callable(own) else own
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    """Text only: it is built without a session and reads nothing of the Spark installation."""
    return _all("SQL")
