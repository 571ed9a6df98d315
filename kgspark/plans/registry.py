"""Every driver query of the library's operators with its oracle, by name."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MODULES = ("kg_queries", "text_queries", "analytics_queries", "ingest_queries", "resolution_queries", "upkeep_queries", "answer_queries")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def over_tables(name: str, tables: str, oracle: str | None = None):  # noqa: ANN201
    """Registers a function of the named tables as a driver query."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(*[table(spark, sf_dir, t) for t in tables.split()])
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def over_graph(name: str, oracle: str | None = None, recursive: bool = False):  # noqa: ANN201
    """Registers a function of the claims of the derived graph; the oracle continues the WITH list that ends with claims, edges and nodes."""
    from kgspark.plans.fixtures import KG_SQL, claims

    def add(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(claims(spark, sf_dir))
        if oracle:
            ORACLES[name] = (KG_SQL.replace("with o as", "with recursive o as", 1) if recursive else KG_SQL) + oracle
        return f

    return add


def _load() -> None:
    for m in MODULES:
        import_module(f"kgspark.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
