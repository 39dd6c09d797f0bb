"""The registry of queries: a name, the survey rows it covers, a callable and its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    operators: str
    run: Run
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(operators: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Registers a function under its own name."""

    def add(run: Run) -> Run:
        if run.__name__ in REGISTRY:
            raise ValueError(f"{run.__name__} is registered twice")
        REGISTRY[run.__name__] = Query(run.__name__, operators, run, sql)
        return run

    return add
