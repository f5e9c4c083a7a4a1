"""Registry of named queries with their equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from coord.sources.standins import BASE_TABLES, STANDINS, base, standin, standin_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"


def query(name: str, *tables: str, sql: str | None = None, stream: tuple[str, ...] = ()):
    """Register ``fn(spark, *frames)``; ``tables`` name given or derived tables, opened lazily.

    Those also named in ``stream`` are opened as streams.
    """

    def wrap(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            frames = [
                standin_stream(spark, sf_dir, t) if t in stream
                else base(spark, sf_dir, t) if t in BASE_TABLES
                else standin(spark, sf_dir, t)
                for t in tables
            ]
            return fn(spark, *frames)

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ctes = [f"{t} AS ({STANDINS[t]})" for t in tables if t not in BASE_TABLES]
            head = f"WITH {', '.join(ctes)} " if ctes else ""
            ORACLE[name] = f"{head}SELECT * FROM (\n{sql}\n) AS answer"
        return fn

    return wrap
