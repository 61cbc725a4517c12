"""The register of queries: each with the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trialscope.plans.adapters import SPANS_SQL, TRIALS_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, uses: str = ""):
    """Registers a query under its function's name; uses names the adapter whose SQL comes first."""
    prelude = {"trials": TRIALS_SQL, "spans": SPANS_SQL, "": ""}[uses]

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            text = sql.strip()
            ORACLES[f.__name__] = (f"WITH {prelude.strip()}" + (", " + text[5:] if text.startswith("WITH ") else " " + text)) if prelude else text
        return f

    return register
