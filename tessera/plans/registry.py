"""Registered queries: each name with its Spark callable and its oracle SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def use_tables(spark: SparkSession, sf_dir: str, text: str) -> None:
    """Register the driver tables that a text names as temporary views."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", text):
            table(spark, sf_dir, name).createOrReplaceTempView(name)


def query(name: str, oracle: str | None = None):
    """Register a callable (spark, sf_dir) -> DataFrame under ``name``."""

    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def sql(name: str, text: str, oracle: str | None = None) -> None:
    """Register engine SQL (all rewrites of ``plans.sql`` apply); the oracle is the text itself unless given."""

    def fn(spark: SparkSession, sf_dir: str) -> DataFrame:
        from tessera.plans.sql import run_sql

        use_tables(spark, sf_dir, text)
        return run_sql(spark, text)

    QUERIES[name] = fn
    ORACLES[name] = oracle or text


from tessera.plans import catalogue  # noqa: E402, F401  (fills the registry)
