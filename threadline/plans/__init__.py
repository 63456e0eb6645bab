"""Registered queries: each has a DataFrame plan and, where SQL can express it, DuckDB text over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]


def registry() -> dict[str, tuple[Plan, str | None]]:
    from threadline.plans import audits, channels, cohorts, collisions, files, intervals, ledgers, models, nulls, primitives, sequences, survivals, texts

    found: dict[str, tuple[Plan, str | None]] = {}
    for module in (cohorts, channels, primitives, ledgers, sequences, survivals, audits, models, intervals, nulls, collisions, files, texts):
        for name, query in module.QUERIES.items():
            if name in found:
                raise ValueError(f"two queries are named {name}")
            found[name] = query
    return found
