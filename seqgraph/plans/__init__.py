"""Queries over the given tables, one for each operator, with DuckDB SQL for the same rows."""

from importlib import import_module

MODULES = ("sequences", "prediction", "harmony", "color", "operations", "embeddings", "reports", "recommend")


def _merged(name: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(import_module(f"{__name__}.{m}"), name).items()}


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("ORACLE")
