"""Every query by name, as a function of (spark, sf_dir), with its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .model import with_model

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = with_model(oracle)
        return f

    return add


from . import functions_queries, matching_queries, reading_queries, settling_queries, source_queries, stream_queries, writing_queries  # noqa: E402, F401
