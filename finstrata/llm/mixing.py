"""Mixing of sources to target weights by balanced (cube) sampling."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finstrata.llm.common import n_words, written

#: Units that one flight takes; larger sources are cut into buckets whose few undecided units fly again together.
FLIGHT = 4096


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """``source, n, source_size, target`` from rows of ``source, size``.

    Sources in code point order, null last, weigh *weights* in turn and share *share* times all sizes; a target stops
    at *cap* times its source's size, and the excess goes to the others by weight until none is above. That is
    ``min(cap * size, level * weight)`` at the level that uses up the total: sources are ordered by the level at which
    each fills up, and running sums tell which are full. The windows run over one row per source.
    """
    ordered, by_full = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("full", F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int"))
    s = sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size")).withColumn("w", turn)
    s = s.withColumn("full", cap * F.col("source_size") / F.col("w"))
    upto, everyone = by_full.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    s = s.withColumns({"caps": cap * F.sum("source_size").over(upto), "ws": F.sum("w").over(upto), "all_w": F.sum("w").over(everyone), "total": share * F.sum("source_size").over(everyone)})
    s = s.withColumn("is_full", F.col("caps") + F.col("full") * (F.col("all_w") - F.col("ws")) <= F.col("total"))
    s = s.withColumns({"caps": F.sum(F.when(F.col("is_full"), cap * F.col("source_size")).otherwise(0.0)).over(everyone), "free": F.sum(F.when(F.col("is_full"), 0.0).otherwise(F.col("w"))).over(everyone)})
    level = F.col("w") * (F.col("total") - F.col("caps")) / F.nullif(F.col("free"), F.lit(0.0))
    return s.select("source", "n", "source_size", F.when(F.col("is_full"), cap * F.col("source_size")).otherwise(F.least(level, cap * F.col("source_size"))).cast("double").alias("target"))


def fly(size: np.ndarray, pi: np.ndarray, rng: np.random.Generator, land: bool) -> np.ndarray:
    """Moves probabilities to 0 or 1, keeping sum(pi * size) and sum(pi) as they are; at most two stay between.

    Three undecided units at a time: the direction that leaves both totals alone is the cross product of the units'
    sizes and ones. With *land* the last two are decided too: the document total gives way first, then chance.
    """
    p = pi.tolist()
    s = [float(x) for x in size]
    draws = iter(rng.random(2 * len(p) + 8).tolist())
    active: list[int] = []

    def move(units: list[int], u: list[float]) -> None:
        ahead = min((1 - p[i]) / d if d > 0 else p[i] / -d for i, d in zip(units, u, strict=True) if d)
        back = min(p[i] / d if d > 0 else (1 - p[i]) / -d for i, d in zip(units, u, strict=True) if d)
        step = ahead if next(draws) * (ahead + back) < back else -back
        for i, d in zip(units, u, strict=True):
            p[i] += step * d
            if p[i] < 1e-9:
                p[i] = 0.0
            elif p[i] > 1 - 1e-9:
                p[i] = 1.0

    for i in range(len(p)):
        if not 0 < p[i] < 1:
            continue
        active.append(i)
        while len(active) == 3:
            a, b, c = (s[k] for k in active)
            u = [b - c, c - a, a - b]
            move(active, u if any(u) else [1.0, -1.0, 0.0])
            active = [k for k in active if 0 < p[k] < 1]
    if len(active) == 2 and s[active[0]] == s[active[1]]:
        move(active, [1.0, -1.0])
        active = [k for k in active if 0 < p[k] < 1]
    if land:
        if len(active) == 2:
            move(active, [s[active[1]], -s[active[0]]])
            active = [k for k in active if 0 < p[k] < 1]
        for k in active:
            p[k] = float(next(draws) < p[k])
    return np.array(p)


def _flight(round_no: int, land: bool, seed: int):
    def flight(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "h"], ascending=[False, True], kind="stable")
        name = f"{seed}/{round_no}/{rows['source'].iloc[0]}/{rows['bucket'].iloc[0]}".encode()
        rng = np.random.default_rng(int.from_bytes(hashlib.sha256(name).digest()[:8], "big"))
        return rows.assign(pi=fly(rows["size"].to_numpy(), rows["pi"].to_numpy(), rng, land))
    return flight


def balanced_sample(units: DataFrame, largest: int, seed: int = 0) -> DataFrame:
    """``pi`` of each row decided to 0 or 1, balancing token and document totals of each source.

    *units* has ``source, size, pi, h`` (a hash that tells rows apart), and ``n`` rows of its source, at most *largest*.
    Each round flies buckets of about FLIGHT units and hands on the two or fewer that a bucket leaves, until a source
    is one bucket; there the last two land. The same rows give the same sample.
    """
    done, round_no, buckets = [], 0, F.ceil(F.col("n") / FLIGHT)
    most = -(-largest // FLIGHT)
    left = units
    while True:
        last = most <= 1
        part = left.withColumn("bucket", F.pmod(F.xxhash64("h", F.lit(round_no)), F.greatest(buckets, F.lit(1))))
        flown = written(part.groupBy("source", "bucket").applyInPandas(_flight(round_no, last, seed), part.schema).drop("bucket"), "mix-flight")
        done.append(flown.where(F.col("pi").isin(0.0, 1.0)))
        if last:
            break
        left, round_no = flown.where(~F.col("pi").isin(0.0, 1.0)), round_no + 1
        buckets, most = F.ceil(2 * buckets / FLIGHT), -(-2 * most // FLIGHT)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 0) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` for each row of *df*; other columns are left out.

    A document is taken whole as often as its source's ratio of target to size says, its fraction decided by balanced
    sampling; so ``taken`` is at most *cap* (a whole number) times ``size``, and each source's sum misses its target by
    less than two of its smaller documents. Null texts have size 0; a source of no words has target 0; a null source
    is a source of its own, and null ids and repeated rows are units like any other. Reruns agree. An empty table
    gives an empty result.
    """
    sizes = written(df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size")), "mix-sizes")
    targets = written(source_targets(sizes, weights, share, cap), "mix-targets").withColumnRenamed("source", "s")
    rows = sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies"))
    rows = rows.join(targets, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")
    ratio = F.least(F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0)), F.lit(float(cap)))
    rows = rows.withColumn("times", F.floor(ratio)).withColumn("pi", ratio - F.col("times")).withColumn("h", F.xxhash64("doc_id", "size", "copy")).drop("copy")
    flies = (F.col("pi") > 0) & (F.col("size") > 0)
    largest = targets.agg(F.max("n")).first()[0] or 0
    out = rows.where(~flies).withColumn("pi", F.lit(0.0)).unionByName(balanced_sample(rows.where(flies), largest, seed))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * (F.col("times") + F.col("pi").cast("long"))).alias("taken"))
