"""Collects the queries and oracles of the core modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from citeloom.plans import corpus_queries, data_quality, eval_queries, graph_queries, retrieval_queries, stream_queries, text_queries, verdict_queries

MODULES = [data_quality, text_queries, graph_queries, retrieval_queries, verdict_queries, eval_queries, corpus_queries, stream_queries]


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return verdict_queries.check_references(spark, sf)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def _counts_as_bigint(sql: str) -> str:
    """count_if(...) gives a wider integer in the oracle's engine than count(*); both sides shall have the same type."""
    out, at = [], 0
    while (i := sql.find("count_if(", at)) >= 0:
        depth, j = 1, i + len("count_if(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            j += 1
        out += [sql[at:i], "CAST(", sql[i:j], " AS BIGINT)"]
        at = j
    return "".join(out) + sql[at:]


def oracle_sql() -> dict[str, str]:
    return {name: _counts_as_bigint(sql) for m in MODULES for name, sql in m.ORACLES.items()}
