"""Vendor records land compressed and read back whole."""

import os

from finstrata.plans.catalog import j_store, p_vendor


class _Universe:
    def __init__(self, spark):
        self.spark, self.dir = spark, "test-vendor-landing"
        self.snapshots = spark.createDataFrame([("S1", "2001-01-31 00:00:00", 2.0, 10.0, None), ("S2", "2001-01-31 00:00:00", 3.0, None, 0.5)],
                                               "ticker string, collected_at string, current_price double, market_cap double, beta double").selectExpr("* except (collected_at)", "cast(collected_at as timestamp) as collected_at")
        self.company = spark.createDataFrame([("S1", "One", "1001"), ("S2", "Two", "1002")], "ticker string, company_name string, sic string")


def test_landed_compressed(spark):
    u = _Universe(spark)
    got = {r["ticker"]: r["shares_outstanding"] for r in p_vendor.stats(u).collect()}
    assert got == {"S1": 10.0, "S2": None}
    path = j_store._LANDED[(spark.sparkContext.applicationId, u.dir, "vendor_info")].replace("file:", "")
    assert all(f.endswith(".gz") for f in os.listdir(path) if f.startswith("part-"))
