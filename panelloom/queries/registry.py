"""Registry of the queries over the given tables and of their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelloom.queries.roles_sql import CTES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def sql(needs: str, body: str) -> str:
    """`body` preceded by the role CTEs it names, with the roles those build on."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in ordered:
            return
        uses, _ = CTES[name]
        for other in uses.split():
            add(other)
        ordered.append(name)

    for name in needs.split():
        add(name)
    if not ordered:
        return body
    parts = ",\n".join(f"{name} AS ({CTES[name][1]})" for name in ordered)
    text = body.lstrip()
    for head in ("WITH RECURSIVE ", "WITH "):
        if text.startswith(head):
            return f"{head}{parts},\n{text[len(head):]}"
    return f"WITH {parts}\n{text}"


def query(name: str, oracle: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame and, if given, its SQL."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register
