"""The registered queries and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reelforge.plans import alignment, catalogs, choices, facts, forms, listings, merging, series, sources, syncing, viewing

QUERIES = {**merging.QUERIES, **facts.QUERIES, **series.QUERIES, **sources.QUERIES, **catalogs.QUERIES, **viewing.QUERIES, **choices.QUERIES, **alignment.QUERIES, **syncing.QUERIES, **listings.QUERIES, **forms.QUERIES}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
