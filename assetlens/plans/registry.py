"""Named queries over the given tables, each with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from assetlens.sources.tables import Tables


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    build: Callable[[Tables], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(covers: str, sql: str | None = None):
    """Register the decorated builder under its function name."""

    def add(fn):
        name = fn.__name__
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, covers, fn, sql)
        return fn

    return add


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return QUERIES[name].build(Tables(spark, sf_dir))
