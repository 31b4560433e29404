"""All queries over the engine's own operators, with the SQL that each must agree with and the operators that it covers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .adapters import Tables, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
COVERS: dict[str, str] = {}
FLAGSHIP = "funnel_steps"


def query(covers: str, sql: str | None = None) -> Callable:
    """Register a function of Tables under its name; `covers` names operators of the survey."""

    def add(function: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        name = function.__name__
        QUERIES[name] = lambda spark, sf_dir: function(Tables(spark, sf_dir))
        COVERS[name] = covers
        if sql:
            ORACLE_SQL[name] = oracle(sql)
        return function

    return add


from . import boards, bundles, findings, graphs, inputs, ledger, logs, texts  # noqa: E402, F401
