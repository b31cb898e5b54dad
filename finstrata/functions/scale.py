"""Exact order statistics and as-of joins that hold when one group has a third of all rows.

``cume_dist``/``row_number``/``percentile`` over a whole sector or universe would sort (or buffer)
the group in one task. Here a group is first collapsed to one row per distinct value, the values are
cut into order-preserving buckets by a fixed function of the value (so a retried task cuts
identically), and counts are added up bucket by bucket. Only bucket totals, whose number is bounded
by the double format and not by the data, meet in a single window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_STEPS_PER_OCTAVE = 256


def order_bucket(value: Column) -> Column:
    """A bucket number that never decreases as *value* grows: 256 buckets per power of two."""
    v = value.cast("double")
    magnitude = F.floor((F.log2(F.abs(v)) + F.lit(1100.0)) * _STEPS_PER_OCTAVE) + 1
    return (F.when(v > 0, magnitude).when(v < 0, -magnitude).otherwise(F.lit(0))).cast("bigint")


def _cumulative_counts(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """One row per (group, distinct value): __n ties, __le values at or below, __total in the group."""
    g = list(groups)
    counts = (df.where(F.col(value).isNotNull()).groupBy(*g, value)
              .agg(F.count(F.lit(1)).alias("__n"))
              .withColumn("__b", order_bucket(F.col(value))))
    per_bucket = counts.groupBy(*g, "__b").agg(F.sum("__n").alias("__bn"))
    across = Window.partitionBy(*g) if g else Window.partitionBy(F.lit(0))
    offsets = per_bucket.select(
        *g, "__b",
        F.coalesce(F.sum("__bn").over(across.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("__before"),
        F.sum("__bn").over(across).alias("__total"))
    inside = Window.partitionBy(*g, "__b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return (counts.withColumn("__in", F.sum("__n").over(inside))
            .join(offsets, [*g, "__b"])
            .select(*g, value, "__n", (F.col("__before") + F.col("__in")).alias("__le"), "__total"))


def _keyed(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """*df* with its key columns renamed ``__k0 ..`` so that it joins back to its own source unambiguously."""
    for i, n in enumerate(names):
        df = df.withColumnRenamed(n, f"__k{i}")
    return df


def _same(names: Sequence[str]) -> list[Column]:
    return [F.col(n) == F.col(f"__k{i}") for i, n in enumerate(names)]


def percentile_of(df: DataFrame, groups: Sequence[str], value: str, lower_better: Column,
                  out: str = "pct", n_out: str | None = None) -> DataFrame:
    """Adds each row's share of its group at or below its value (at or above, where *lower_better*)."""
    keys = [*groups, value]
    cum = _keyed(_cumulative_counts(df, groups, value), keys)
    pct = (F.when(lower_better, F.col("__total") - F.col("__le") + F.col("__n"))
           .otherwise(F.col("__le")) / F.col("__total"))
    more = [pct.alias(out)] + ([F.col("__total").alias(n_out)] if n_out else [])
    return df.join(cum, _same(keys), "left").select(*df.columns, *more)


def ordinal(df: DataFrame, groups: Sequence[str], value: str, tie: str, out: str,
            descending: bool = False, prefix: int = 6) -> DataFrame:
    """Adds the 1-based position by (*value*, *tie* ascending) inside the group; *tie* is a unique string.

    Rows of equal value are numbered within the first *prefix* characters of *tie*, so even a heavy tie is split; a
    zero-padded number needs a prefix that reaches its changing digits.
    """
    g = list(groups)
    cum = _cumulative_counts(df, g, value)
    start = (F.col("__total") - F.col("__le")) if descending else (F.col("__le") - F.col("__n"))
    base = cum.select(*g, value, start.alias("__start"))
    marked = df.where(F.col(value).isNotNull()).withColumn("__p", F.substring(F.col(tie), 1, prefix))
    parts = marked.groupBy(*g, value, "__p").agg(F.count(F.lit(1)).alias("__pn"))
    w = Window.partitionBy(*g, value).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__skip", F.coalesce(F.sum("__pn").over(w), F.lit(0))).drop("__pn")
    keys = [*g, value, "__p"]
    offsets = _keyed(parts.join(base, [*g, value]), keys)
    within = Window.partitionBy(*keys).orderBy(tie)
    numbered = marked.withColumn("__i", F.row_number().over(within))
    return numbered.join(offsets, _same(keys)).select(
        *df.columns, (F.col("__start") + F.col("__skip") + F.col("__i")).cast("bigint").alias(out))


def exact_percentiles(df: DataFrame, groups: Sequence[str], value: str,
                      wanted: dict[str, float], n_out: str | None = None) -> DataFrame:
    """Exact inclusive percentiles per group without holding a group in one task.

    *wanted* maps output column to fraction. Each target position k lies in the one distinct value
    whose cumulative span [le - n, le) holds it, so a partial aggregate picks it out.
    """
    g = list(groups)
    cum = _cumulative_counts(df, g, value)
    aggs = []
    for name, p in wanted.items():
        pos = (F.col("__total") - 1) * F.lit(float(p))
        for tag, k in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (F.col("__le") - F.col("__n") <= k) & (k < F.col("__le"))
            aggs.append(F.max(F.when(hit, F.col(value))).alias(f"__{name}_{tag}"))
    aggs.append(F.max("__total").alias("__total"))
    picked = cum.groupBy(*g).agg(*aggs)
    out = []
    for name, p in wanted.items():
        pos = (F.col("__total") - 1) * F.lit(float(p))
        lo, hi = F.col(f"__{name}_lo"), F.col(f"__{name}_hi")
        out.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    if n_out:
        out.append(F.col("__total").alias(n_out))
    return picked.select(*g, *out)


def asof_lookup(probes: DataFrame, history: DataFrame, keys: Sequence[str], probe_day: str,
                day: str, payload: Sequence[str]) -> DataFrame:
    """Adds to each probe the *payload* of the latest history row with ``day <= probe_day``.

    Both sides are reduced to one row per (key, day) before the window, so a window group is bounded
    by calendar days however many probes share the key; the result is joined back on (key, day).
    History must hold at most one row per (key, day).
    """
    k = list(keys)
    asked = probes.select(*k, F.col(probe_day).alias("__day")).where(F.col("__day").isNotNull()).distinct()
    rows = history.select(*k, F.col(day).alias("__day"), F.struct(F.col(day).alias("__at"), *payload).alias("__v"),
                          F.lit(0).alias("__probe"))
    union = rows.unionByName(asked.select(*k, "__day", F.lit(None).cast(rows.schema["__v"].dataType).alias("__v"),
                                          F.lit(1).alias("__probe")))
    w = Window.partitionBy(*k).orderBy("__day", "__probe").rowsBetween(Window.unboundedPreceding, 0)
    found = (union.withColumn("__hit", F.last("__v", ignorenulls=True).over(w))
             .where(F.col("__probe") == 1)
             .select(*k, F.col("__day").alias(probe_day), F.col("__hit.__at").alias(f"{day}_found"),
                     *[F.col(f"__hit.{p}").alias(p) for p in payload]))
    return probes.join(found, [*k, probe_day], "left")
