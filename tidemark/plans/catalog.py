"""Every query of the library with its SQL counterpart."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import documents, fields, handles, indicators, matches, points_in_time, quality, scalars, term_sheets

PLANS = (indicators, points_in_time, matches, quality, scalars, documents, handles, term_sheets, fields)
Query = Callable[[SparkSession, str], DataFrame]


def _importable(query: Query) -> Query:
    """The query with this package on the path of Python workers, wherever the driver was started."""
    root = str(Path(__file__).resolve().parents[2])

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        env = spark.sparkContext.environment
        paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
        if root not in paths:
            env["PYTHONPATH"] = os.pathsep.join([root, *paths])
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    return {name: _importable(query) for plan in PLANS for name, query in plan.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plan in PLANS for name, sql in plan.ORACLE_SQL.items()}
