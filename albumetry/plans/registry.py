"""Named queries over the supplied tables with their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers fn(spark, sf_dir) under a name."""

    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def joined(c: str | Column, sep: str = "|") -> Column:
    """List as one text, so that results compare by value."""
    return F.array_join(c, sep)


def epoch(c: str) -> Column:
    return F.unix_micros(c).alias(c)
