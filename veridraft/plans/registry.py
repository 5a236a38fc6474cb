"""Registered queries: a Spark plan and, where SQL can say it, the SQL to compare with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from veridraft.plans.views_sql import VIEWS
from veridraft.sources.adapters import Views


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Views], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Views(spark, folder))


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register ``build(views) -> DataFrame``. ``views`` are put before ``sql`` as CTEs."""

    def register(build: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        text = None
        if sql is not None:
            ctes = [f"{v} AS ({VIEWS[v]})" for v in views]
            body = sql.strip()
            if ctes and body[:4].upper() == "WITH":
                text = "WITH " + ", ".join(ctes) + ", " + body[4:].strip()
            elif ctes:
                text = "WITH " + ", ".join(ctes) + " " + body
            else:
                text = body
        QUERIES[name] = Query(name, build, text)
        return build

    return register


def all_queries() -> dict[str, Query]:
    from veridraft.plans import (  # noqa: F401  (importing registers)
        decisions, documents, evidence, labels, passports, pipeline, retrieval, scoring, sources, streams,
        triage,
    )

    return dict(sorted(QUERIES.items()))
