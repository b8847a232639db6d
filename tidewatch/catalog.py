"""All queries over the given tables, by name, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from .plans import breaks, features, inputs, maps, series  # noqa: F401  their queries register themselves


def flagship(spark, sf_dir: str):
    return series.indicator_trends(spark, sf_dir)


def queries() -> dict:
    return dict(inputs.QUERIES)


def oracle_sql() -> dict:
    return dict(inputs.ORACLES)
