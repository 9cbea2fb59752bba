"""Names of the registered queries, their Spark plans and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import share_code
from ..tables import spread

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, query: Query, oracle: str | None = None) -> None:
    """Add a query; ``oracle`` is DuckDB SQL with the same column names, if SQL can express it."""
    if name in _QUERIES:
        raise ValueError(f"query registered twice: {name}")
    _QUERIES[name] = query
    if oracle is not None:
        _ORACLES[name] = oracle


def _load() -> None:
    """Import the modules that register queries; importing again does nothing."""
    from . import answer_queries, catalog_queries, evaluation_queries, index_queries, page_queries, retrieval_queries, text_queries  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, dealt over all cores for work on their texts."""
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def queries() -> dict[str, Query]:
    """Every query by name; each makes sure that workers find this package."""
    _load()
    return {name: shared(query) for name, query in _QUERIES.items()}


def shared(query: Query) -> Query:
    """``query``, in a session whose workers find this package."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        share_code(spark)
        return query(spark, sf_dir)

    return run


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
