"""Registry of reports: a name, the Spark query, and the SQL that defines its result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from cohortry.sources.tables import TableFolder

Query = Callable[[SparkSession, str], DataFrame]


class Tables(TableFolder):
    """The given tables of one folder."""


@dataclass(frozen=True)
class Report:
    name: str
    run: Query
    sql: str | None


REPORTS: dict[str, Report] = {}


def report(sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Register a function of the tables under its own name."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        name = build.__name__
        if name in REPORTS:
            raise ValueError(f"two reports named {name}")
        REPORTS[name] = Report(name, lambda spark, folder: build(Tables(spark, folder)), sql)
        return build

    return register
