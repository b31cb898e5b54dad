"""Worked cases and brute-force checks of the order-dependent operators."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from finstrata import registry as reg
from finstrata import sinks
from finstrata.operators import insiders, market, periods, resolve, snapshots, splits, timeseries, valuation
from finstrata.sources import files, filings


def test_registry_size():
    assert len(reg.FIELDS) == 79 and len(set(reg.FIELDS)) == 79


def test_ttm_gap_breaks_the_window(spark):
    ends = ["2020-03-31", "2020-06-30", "2020-09-30", "2020-12-31", "2021-06-30", "2021-09-30"]
    q = spark.createDataFrame([("A", e, 10.0) for e in ends], "ticker string, period_end string, revenue double").withColumn("period_end", F.to_date("period_end"))
    got = periods.compute_ttm(q, ["revenue"]).collect()
    assert [(str(r["period_end"]), r["revenue"]) for r in got] == [("2020-12-31", 40.0)]


def test_ttm_needs_all_four_values(spark):
    q = spark.createDataFrame([("A", f"2020-{m}", v) for m, v in (("03-31", 1.0), ("06-30", None), ("09-30", 1.0), ("12-31", 1.0))],
                              "ticker string, period_end string, revenue double").withColumn("period_end", F.to_date("period_end"))
    assert periods.compute_ttm(q, ["revenue"]).first()["revenue"] is None


def test_clusters_match_the_greedy_walk(spark):
    rnd = random.Random(3)
    base = dt.date(2024, 1, 1)
    rows = [("A", base + dt.timedelta(days=rnd.randrange(200)), rnd.randrange(9), 10.0, 2.0, "P") for _ in range(80)]
    df = spark.createDataFrame(rows, "ticker string, date date, owner_cik int, shares double, price double, code string")
    got = sorted((r["start"], r["end"], r["buyers"]) for r in insiders.clusters(df).collect())
    ordered = sorted(rows, key=lambda r: r[1])
    want, i = [], 0
    while i < len(ordered):
        run = [r for r in ordered[i:] if r[1] <= ordered[i][1] + dt.timedelta(days=30)]
        if len({r[2] for r in run}) >= 3:
            want.append((run[0][1], run[-1][1], len({r[2] for r in run})))
            i += len(run)
        else:
            i += 1
    assert got == want and want


def test_amendments_take_over_one_for_one(spark):
    f = spark.createDataFrame([("F1", "A", 1, "4", "2024-01-02", None, "2024-01-01"), ("F2", "A", 1, "4/A", "2024-01-05", "2024-01-02", "2024-01-01"), ("F3", "A", 1, "4/A", "2024-01-09", "2024-01-05", "2024-01-01")],
                              "accession string, ticker string, owner_cik long, form string, filed_date string, original_filed string, period_of_report string")
    f = f.withColumns({c: F.to_date(c) for c in ("filed_date", "original_filed", "period_of_report")})
    assert {(r["accession"], r["root"]) for r in insiders.amendment_chains(f).collect()} == {("F1", "F1"), ("F2", "F1"), ("F3", "F1")}
    t = spark.createDataFrame([("F1", 0, "P", 10.0, 5.0), ("F1", 1, "P", 10.0, 5.0), ("F2", 0, "S", 10.0, 5.0), ("F3", 0, "S", 10.0, 6.0)], "accession string, seq int, code string, shares double, price double")
    t = t.withColumns({"kind": F.lit("nonderivative"), "security_title": F.lit("Common"), "date": F.lit("2024-01-01").cast("date")})
    got = {(r["accession"], r["seq"], r["restated_by"]) for r in insiders.restated_trades(f, t).collect()}
    assert got == {("F1", 0, "F2"), ("F2", 0, "F3")}


def test_snapshots_read_on_a_day_equal_the_record_rebuilt_from_facts_known_then(spark):
    rnd = random.Random(11)
    tags = ["Revenues", "SalesRevenueNet", "NetIncomeLoss", "ProfitLoss"]
    rows = []
    for i in range(300):
        y = rnd.randrange(2015, 2019)
        rows.append(("A" if rnd.random() < 0.8 else "B", rnd.choice(tags), "USD", dt.date(y, 1, 1), dt.date(y, 12, 31), float(rnd.randrange(1, 60)), f"F{i}", "10-K",
                     dt.date(y + 1, 1, 1) + dt.timedelta(days=rnd.randrange(900))))
    facts = spark.createDataFrame(rows, "ticker string, tag string, unit string, start date, end date, val double, accn string, form string, filed date")
    r = reg.registry(spark)
    known = snapshots.build_snapshots(facts, r, ["revenue", "net_income"])
    day = F.lit("2018-06-30").cast("date")
    probes = facts.select("ticker", F.year("end").alias("fiscal_year")).distinct().withColumn("day", day)
    got = {(x["ticker"], x["fiscal_year"]): (x["revenue"], x["net_income"]) for x in resolve.as_of_annual(known, probes).collect()}
    rebuilt = resolve.to_wide(resolve.annual_record(facts.where(F.col("filed") <= day), r), ["ticker", "fiscal_year"], ["revenue", "net_income"])
    want = {(x["ticker"], x["fiscal_year"]): (x["revenue"], x["net_income"]) for x in rebuilt.collect()}
    assert got == want and want


def test_tombstone_hides_the_year(spark):
    k = spark.createDataFrame([("A", 2022, "2023-02-10", True, 80.0), ("A", 2022, "2023-08-15", True, 82.0), ("A", 2022, "2024-01-01", False, None)],
                              "ticker string, fiscal_year int, known_from string, present boolean, net_income double").withColumn("known_from", F.to_date("known_from"))
    p = spark.createDataFrame([("A", 2022, d) for d in ("2023-01-01", "2023-03-01", "2023-09-01", "2024-02-01")], "ticker string, fiscal_year int, day string").withColumn("day", F.to_date("day"))
    assert sorted(r["net_income"] for r in resolve.as_of_annual(k, p).collect()) == [80.0, 82.0]


@pytest.mark.parametrize("ratio,simple", [(2.0, True), (1.5, True), (2.25, True), (0.125, True), (10.0, True), (2.0842, False), (1.281, False), (1.04, False), (1 / 3, True), (1.0, False)])
def test_share_split(spark, ratio, simple):
    assert spark.range(1).select(splits.is_share_split(F.lit(ratio)).alias("x")).first()["x"] is simple


def test_dcf_and_its_inverse(spark):
    row = spark.range(1).select(valuation.dcf_per_share(F.lit(100.0), F.lit(10.0), F.lit(0.05), F.lit(0.1)).alias("v"))
    v = row.first()["v"]
    f, total = 100.0, 0.0
    for t in range(1, 11):
        f *= 1 + (0.05 if t <= 5 else 0.05 + (0.025 - 0.05) * (t - 5) / 5)
        total += f / 1.1 ** t
    assert v == pytest.approx((total + f * 1.025 / 0.075 / 1.1 ** 10) / 10)
    g = spark.range(1).select(valuation.implied_growth(F.lit(100.0), F.lit(10.0), F.lit(v), F.lit(0.1)).alias("g")).first()["g"]
    assert g == pytest.approx(0.05, abs=1e-6)


def test_oscillators_flat_and_rising(spark):
    days = [(k, dt.date(2024, 1, 1) + dt.timedelta(days=i), 100.0 + (i if k == "UP" else 0)) for k in ("UP", "FLAT") for i in range(40)]
    o = timeseries.oscillators(spark.createDataFrame(days, "ticker string, date date, close double")).collect()
    assert {r["rsi"] for r in o if r["ticker"] == "FLAT" and r["rsi"] is not None} == {50.0}
    assert {r["rsi"] for r in o if r["ticker"] == "UP" and r["rsi"] is not None} == {100.0}
    assert sum(r["rsi"] is None for r in o if r["ticker"] == "UP") == 14 and sum(r["macd"] is None for r in o if r["ticker"] == "UP") == 26


def test_episodes_join_across_short_gaps(spark):
    days = [(dt.date(2024, 1, 1) + dt.timedelta(days=i), i < 25 or 30 <= i < 40 or i > 90) for i in range(95)]
    d = spark.createDataFrame([("s", a, -1.0 if b else 1.0, b) for a, b in days], "spread string, date date, value double, inverted boolean")
    got = market.episodes(d).collect()
    assert [(r["first"], r["last"], r["days"]) for r in got] == [(dt.date(2024, 1, 1), dt.date(2024, 2, 9), 35)]


def test_upsert_modes(spark):
    a = spark.createDataFrame([(1, 1.0, None), (2, 2.0, 2.0)], "k int, x double, y double")
    b = spark.createDataFrame([(1, None, 9.0), (3, 3.0, 3.0)], "k int, x double, y double")
    rows = lambda mode: sorted(tuple(r) for r in sinks.merge_upsert(a, b, ["k"], mode).collect())
    assert rows("overwrite") == [(1, None, 9.0), (2, 2.0, 2.0), (3, 3.0, 3.0)]
    assert rows("keep_existing") == rows("fill_only") == [(1, 1.0, 9.0), (2, 2.0, 2.0), (3, 3.0, 3.0)]


def test_duplicate_rate_date_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("DATE,GDP\n2020-01-01,1\n2020-01-01,2\n2020-04-01,.\n")
    with pytest.raises(Exception, match="twice"):
        files.read_fred_csv(spark, str(tmp_path / "a.csv"), "x").collect()


def test_ticker_list(spark, tmp_path):
    (tmp_path / "t.txt").write_text("brk.b # class B\n\n# none\nAAPL\naapl\n")
    assert [r["ticker"] for r in files.read_tickers(spark, str(tmp_path / "t.txt")).orderBy("position").collect()] == ["BRK-B", "AAPL"]


def test_instances_keep_the_most_precise_plain_fact(spark):
    x = ('<xbrli:xbrl xmlns:xbrli="http://www.xbrl.org/2003/instance" xmlns:us-gaap="http://fasb.org/us-gaap/2025" xmlns:co="http://co.com/x">'
         '<xbrli:context id="c"><xbrli:entity><xbrli:identifier>0000000005</xbrli:identifier></xbrli:entity><xbrli:period><xbrli:startDate>2024-01-01</xbrli:startDate><xbrli:endDate>2024-12-31</xbrli:endDate></xbrli:period></xbrli:context>'
         '<xbrli:unit id="u"><xbrli:divide><xbrli:unitNumerator><xbrli:measure>iso4217:USD</xbrli:measure></xbrli:unitNumerator><xbrli:unitDenominator><xbrli:measure>xbrli:shares</xbrli:measure></xbrli:unitDenominator></xbrli:divide></xbrli:unit>'
         '<us-gaap:Eps contextRef="c" unitRef="u" decimals="0">6</us-gaap:Eps><us-gaap:Eps contextRef="c" unitRef="u" decimals="2">6.13</us-gaap:Eps><co:Own contextRef="c" unitRef="u" decimals="2">1</co:Own></xbrli:xbrl>')
    docs = spark.createDataFrame([("F1", "A", "5", "10-K", dt.date(2025, 2, 1), bytearray(x.encode()))], "accn string, ticker string, cik string, form string, filed date, content binary")
    got = filings.parse_xbrl_instances(docs).collect()
    assert [(r["tag"], r["unit"], r["val"], r["frame"]) for r in got] == [("Eps", "USD/shares", 6.13, "CY2024")]
