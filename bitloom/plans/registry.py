"""One registry of named queries, each written next to its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a plan builder (spark, sf_dir) -> DataFrame under a name, with its DuckDB SQL."""

    def keep(build):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return keep


def _register() -> None:
    """Import the plan modules, which register their queries."""
    from bitloom.plans import codec_plans, file_plans, media_plans, model_plans, number_plans, tensor_plans, text_plans  # noqa: F401


_register()
