"""Queries with their SQL: a small registrar that the operator modules share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import tables

Query = Callable[[SparkSession, str], DataFrame]
_VIEWS = {"members": (tables.members, tables.MEMBERS), "fragments": (tables.fragments, tables.FRAGMENTS), "blocks": (tables.blocks, tables.BLOCKS)}
_TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


class Catalog:
    """QUERIES and ORACLES of one module."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, oracle: str | None = None) -> Callable[[Query], Query]:
        """Registers a function of (session, folder); `{members}` and the like in the SQL are the stand-ins."""

        def register(f: Query) -> Query:
            self.queries[name] = f
            if oracle:
                self.oracles[name] = oracle.replace("{", "\0").replace("\0members}", tables.MEMBERS).replace("\0fragments}", tables.FRAGMENTS).replace("\0blocks}", tables.BLOCKS).replace("\0", "{")
            return f

        return register

    def sql(self, name: str, query: str, oracle: str | None = None) -> None:
        """A query in SQL over `{members}`, `{documents}` and so on; `oracle` where the other engine spells it differently."""

        def run(spark: SparkSession, folder: str) -> DataFrame:
            used = {k: f(spark, folder, True) if k == "members" and "text" in query else f(spark, folder) for k, (f, _) in _VIEWS.items() if "{" + k + "}" in query}
            used |= {t: tables.read(spark, folder, t) for t in _TABLES if "{" + t + "}" in query}
            return spark.sql(query, **used)

        other = oracle or query
        for t in _TABLES:
            other = other.replace("{" + t + "}", t)
        self.add(name, other)(run)
