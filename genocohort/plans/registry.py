"""All registered queries and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict:
    from . import queries as q
    from . import queries_audit, queries_more, queries_sources, queries_stores  # noqa: F401  register the rest

    return dict(q.QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import queries as q
    from . import queries_audit, queries_more, queries_sources, queries_stores  # noqa: F401

    return dict(q.ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored findings of the fixture cohort."""
    return queries()["pl1_scan"](spark, sf_dir)
