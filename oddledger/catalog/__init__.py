"""Registered queries by group, each with the SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

GROUPS = ["ingest", "checks", "detect", "serving"]


def _groups():
    return [import_module(f"oddledger.catalog.{g}") for g in GROUPS]


def all_queries() -> dict:
    return {name: fn for g in _groups() for name, fn in g.QUERIES.items()}


def all_sql() -> dict:
    return {name: sql for g in _groups() for name, sql in g.SQL.items()}


def flagship(spark, folder: str):
    return all_queries()["u02_recent_flagged"](spark, folder)
