"""Registered queries: a Spark function and, where SQL can say the same, its ANSI text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Registered:
    run: QueryFn
    sql: str | None


REGISTRY: dict[str, Registered] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register the decorated function under its own name."""

    def add(fn: QueryFn) -> QueryFn:
        REGISTRY[name or fn.__name__] = Registered(fn, sql)
        return fn

    return add
