"""Queries and their oracles by name; the modules in quillon.queries fill them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from quillon.functions.columns import NUDGE

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, folder) -> DataFrame under its name, with the SQL that gives the same rows.

    Results are compared to six decimals. Both sides are nudged off decimal ties before rounding (columns.rounded and
    the replacement here), for on a tie the last bit of a sum decides.
    """

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.replace(", 6) AS ", f" + {NUDGE}, 6) AS ")
        return f

    return add


def load() -> None:
    for name in ("evaluation", "advantages", "losses", "metrics", "batches", "texts", "grading", "tokens", "sampling", "stateful", "rounds", "files"):
        import_module(f"quillon.queries.{name}")
