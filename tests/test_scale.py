"""Distributed order statistics against brute force, with one group holding most rows and heavy ties."""

import bisect
import random
import statistics

import pytest
from pyspark.sql import functions as F

from finstrata.functions import scale


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(4000):
        g = "hot" if rnd.random() < 0.7 else f"g{rnd.randrange(5)}"
        v = rnd.choice([-2.5, 0.0, 1e-9, 3.0]) if rnd.random() < 0.5 else rnd.gauss(0, 1e4)
        rows.append((f"T{i:06d}", g, None if rnd.random() < 0.05 else v))
    return rows, spark.createDataFrame(rows, "ticker string, g string, v double")


def groups(rows):
    out = {}
    for t, g, v in rows:
        if v is not None:
            out.setdefault(g, []).append((v, t))
    return out


def test_percentile_of(skewed):
    rows, df = skewed
    by = {g: sorted(v for v, _ in vs) for g, vs in groups(rows).items()}
    for r in scale.percentile_of(scale.percentile_of(df, ["g"], "v", F.lit(False), "hi", "n"), ["g"], "v", F.lit(True), "lo").collect():
        if r["v"] is None:
            assert r["hi"] is None
            continue
        vs = by[r["g"]]
        assert r["n"] == len(vs)
        assert r["hi"] == pytest.approx(bisect.bisect_right(vs, r["v"]) / len(vs))
        assert r["lo"] == pytest.approx((len(vs) - bisect.bisect_left(vs, r["v"])) / len(vs))


@pytest.mark.parametrize("desc", [True, False])
def test_ordinal(skewed, desc):
    rows, df = skewed
    want = {}
    for vs in groups(rows).values():
        for i, (_, t) in enumerate(sorted(vs, key=lambda x: (-x[0] if desc else x[0], x[1])), 1):
            want[t] = i
    assert {r["ticker"]: r["k"] for r in scale.ordinal(df, ["g"], "v", "ticker", "k", desc).collect()} == want


def test_exact_percentiles(skewed):
    rows, df = skewed
    got = {r["g"]: r for r in scale.exact_percentiles(df, ["g"], "v", {"q1": 0.25, "m": 0.5, "q3": 0.75}, "n").collect()}
    for g, vs in groups(rows).items():
        vals = sorted(v for v, _ in vs)
        q = statistics.quantiles(vals, n=4, method="inclusive")
        assert got[g]["n"] == len(vals)
        for k, w in zip(("q1", "m", "q3"), q):
            assert got[g][k] == pytest.approx(w)


def test_asof_lookup(spark):
    h = spark.createDataFrame([("A", "2020-01-01", 1.0), ("A", "2020-02-01", 2.0)], "k string, d string, v double").withColumn("d", F.to_date("d"))
    p = spark.createDataFrame([("A", "2019-12-31"), ("A", "2020-01-01"), ("A", "2020-01-31"), ("A", "2020-03-01"), ("B", "2020-03-01")], "k string, q string").withColumn("q", F.to_date("q"))
    got = [r["v"] for r in scale.asof_lookup(p, h, ["k"], "q", "d", ["v"]).orderBy("k", "q").collect()]
    assert got == [None, 1.0, 1.0, 2.0, None]
