"""Every query of the library by name, with its SQL for an independent engine.

A module of stowage.operators registers its queries in QUERIES (name -> callable of the
session and the folder with the tables) and, where SQL can express one, in ORACLES.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("volumes", "naming", "ordering", "times", "arithmetic", "listing", "joins", "aggregates", "sets", "rewrite", "payloads", "archives", "extraction", "sealed_and_old", "repairs", "comments", "outputs", "building", "encoding", "feeds")


def _gathered(name: str) -> dict:
    found: dict = {}
    for module in MODULES:
        for key, value in getattr(import_module(f"stowage.operators.{module}"), name).items():
            if key in found:
                raise ValueError(f"two queries are named {key}")
            found[key] = value
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _gathered("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gathered("ORACLES")
