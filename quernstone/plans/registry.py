"""Queries over the engine's own operators: name -> (spark, sf_dir) -> DataFrame, each with its DuckDB counterpart."""

from quernstone.plans import data_queries, file_queries, report_queries, table_queries, tag_queries  # noqa: F401  (they register themselves)
from quernstone.plans.base import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
