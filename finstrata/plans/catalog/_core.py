"""Registration of runnable queries and of the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finstrata.plans.standin import Universe, with_relations


@dataclass(frozen=True)
class Entry:
    build: Callable[[Universe], DataFrame]
    sql: str | None
    rounded: tuple[tuple[str, int], ...]


ENTRIES: dict[str, Entry] = {}


def query(name: str, sql: str | None = None, r: str = ""):
    """Registers a query. *r* lists DOUBLE columns rounded on both sides (``name`` or ``name:digits``).

    Large values, whose last digits depend on the order of a sum, keep one decimal.
    """
    def digits(c: str) -> tuple[str, int]:
        n, _, d = c.partition(":")
        return n, int(d or 6)

    def add(build: Callable[[Universe], DataFrame]):
        if name in ENTRIES:
            raise ValueError(f"duplicate query {name}")
        ENTRIES[name] = Entry(build, sql, tuple(digits(c) for c in r.split()))
        return build
    return add


def run(name: str) -> Callable[[SparkSession, str], DataFrame]:
    entry = ENTRIES[name]

    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = entry.build(Universe(spark, sf_dir))
        for c, d in entry.rounded:
            x = F.col(c)
            df = df.withColumn(c, F.when(F.abs(x) < 1e5, F.round(x, d)).when(F.abs(x) < 1e8, F.round(x, 3)).otherwise(F.round(x, 1)))
        return df
    return call


def oracle(name: str) -> str | None:
    entry = ENTRIES[name]
    if entry.sql is None:
        return None
    sql = with_relations(entry.sql)
    if not entry.rounded:
        return sql
    swaps = ", ".join(f"CASE WHEN abs({c}) < 1e5 THEN round({c}, {d}) WHEN abs({c}) < 1e8 THEN round({c}, 3) ELSE round({c}, 1) END AS {c}"
                      for c, d in entry.rounded)
    return f"SELECT * REPLACE ({swaps}) FROM ({sql}) AS rounded"
