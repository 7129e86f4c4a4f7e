"""Statements that set up databases of the three layers, grants, and the view that analysts read."""

from __future__ import annotations

from pyspark.sql import SparkSession

LAYERS = ("bronze", "silver", "gold")


def databases(root: str, prefix: str = "rides") -> list[str]:
    """A database per layer under one root; run them by apply()."""
    return [f"CREATE DATABASE IF NOT EXISTS {prefix}_{layer} LOCATION '{root.rstrip('/')}/{layer}.db'" for layer in LAYERS]


def tables(root: str, names: dict[str, list[str]], prefix: str = "rides") -> list[str]:
    """External tables over the jobs' parquet folders: names by layer."""
    return [f"CREATE TABLE IF NOT EXISTS {prefix}_{layer}.{n} USING parquet LOCATION '{root.rstrip('/')}/{layer}_{n}'" for layer, some in names.items() for n in some]


def grants(engineers: str, analysts: str, catalog: str, prefix: str = "rides") -> list[str]:
    """For catalogs with access control: engineers own all layers, analysts read gold and nothing else."""
    out = [f"GRANT USE CATALOG ON CATALOG {catalog} TO `{who}`" for who in (engineers, analysts)]
    out += [f"GRANT ALL PRIVILEGES ON SCHEMA {catalog}.{prefix}_{layer} TO `{engineers}`" for layer in LAYERS]
    return out + [f"GRANT {right} ON SCHEMA {catalog}.{prefix}_gold TO `{analysts}`" for right in ("USE SCHEMA", "SELECT")]


def analyst_views(matched: str, flagged: str, prefix: str = "rides") -> list[str]:
    """The function that says which rows analysts may see, and the view that applies it."""
    function = f"{prefix}_gold.rows_safe_for_analysts"
    return [
        f"CREATE OR REPLACE FUNCTION {function}(trip_status STRING, fraud_flag BOOLEAN) RETURNS BOOLEAN RETURN trip_status = 'COMPLETED' AND NOT fraud_flag",
        f"CREATE OR REPLACE VIEW {prefix}_gold.analyst_pings AS SELECT m.* FROM {matched} m LEFT JOIN (SELECT DISTINCT driver_id, true AS hit FROM {flagged}) f "
        f"ON m.driver_id = f.driver_id WHERE {function}(m.trip_status, coalesce(f.hit, false))",
    ]


def apply(spark: SparkSession, statements: list[str]) -> None:
    for s in statements:
        spark.sql(s)
