"""Registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import corpus, discovery, news, newsroom, streams


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**news.QUERIES, **discovery.QUERIES, **corpus.QUERIES, **newsroom.QUERIES, **streams.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**news.SQL, **discovery.SQL, **corpus.SQL, **newsroom.SQL, **streams.SQL}
