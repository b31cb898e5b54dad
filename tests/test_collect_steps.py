"""Steps of the collect path against plain readings of their rules, and how often its inputs are read."""

import datetime as dt
import statistics

from pyspark.sql import functions as F

from finstrata import registry as reg
from finstrata.operators import facts as fx
from finstrata.operators import resolve as rs
from finstrata.operators import split_series as ss
from finstrata.plans import collect

FACT = "ticker string, accn string, tag string, unit string, start date, end date, val double, filed date, form string"
START, END, DAY = dt.date(2020, 1, 1), dt.date(2020, 12, 31), dt.date(2021, 2, 1)


def _fact(accn, tag, val, unit="USD", ticker="A", end=END):
    return ticker, accn, tag, unit, START, end, val, DAY, "10-K"


def test_figures_of_a_period_are_read_in_one_pass(spark):
    rows = [_fact("a", "EarningsPerShareBasicAndDiluted", 2.0, "USD/shares"), _fact("a", "EarningsPerShareBasic", 1.0, "USD/shares"), _fact("a", "EarningsPerShareBasic", 3.0, "USD/shares"),
            _fact("b", "EarningsPerShareBasicAndDiluted", 2.0, "USD/shares"), _fact("c", "EarningsPerShareBasic", None, "USD/shares"), _fact("c", "EarningsPerShareBasic", 4.0, "USD/shares"),
            _fact("d", "NetIncomeLoss", 5.0), _fact(None, "EarningsPerShareBasic", 9.0, "USD/shares"), _fact("e", "EarningsPerShareBasic", 9.0, "USD")]
    df = fx._durations(spark.createDataFrame(rows, FACT), {"e": ("eps_basic", reg.TAGS["eps_basic"]), "n": ("net_income", reg.TAGS["net_income"])})
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {r["accn"]: (r["e"], r["has_e"], r["n"], r["has_n"]) for r in df.collect()}
    assert got == {"a": (3.0, True, None, False), "b": (2.0, True, None, False), "c": (None, True, None, False), "d": (None, False, 5.0, True)}


def test_few_candidates_resolve_to_the_same_winners(spark):
    rows = [("A", 1, f, t, p, 3, "plain", v, d, a, END, "10-K") for f in ("x", "y") for t, p, v, d, a in
            (("t1", 1, 1.0, None, "n"), ("t1", 1, 2.0, DAY, "a"), ("t1", 1, 3.0, DAY, "b"), ("t2", 0, -4.0, None, None))]
    c = spark.createDataFrame(rows, "ticker string, fiscal_year int, field string, tag string, priority int, n_tags int, sign string, val double, filed date, accn string, end date, form string")
    aside = spark.createDataFrame([("t2", "y")], "tag string, field string")
    for few in (False, True):
        got = {r["field"]: (r["val"], r["tag"], r["accn"]) for r in rs.resolve_canonical(c, ["ticker", "fiscal_year"], aside, few=few).collect()}
        assert got == {"x": (-4.0, "t2", None), "y": (3.0, "t1", "b")}


def test_lone_quarters_are_judged_once(spark):
    q = spark.createDataFrame([("A", "f", END, 1.0, True), ("A", "f", DAY, 2.0, True), ("A", "g", DAY, 3.0, False), (None, "f", END, 4.0, True), ("A", "h", END, 5.0, None)],
                              "ticker string, field string, period_end date, value double, lone boolean")
    at = spark.createDataFrame([("A", END), ("A", END), (None, END)], "ticker string, period_end date")
    assert sorted(r["value"] for r in rs.quarters_of(q, at).collect()) == [1.0, 3.0]


def test_counts_are_scaled_by_the_two_known_beside_them(spark):
    counts = [100.0, None, 110.0, 0.1, None, 120.0, 130.0, 90.0, 0.095, None]
    cols = "ticker string, k int, net_income double, eps_diluted double, eps_basic double, weighted_avg_shares_diluted double, weighted_avg_shares_basic double, shares_outstanding double"
    df = spark.createDataFrame([("A", i, None, None, None, v, None, None) for i, v in enumerate(counts)], cols)
    got = {r["k"]: r["weighted_avg_shares_diluted"] for r in ss.normalize_share_scale(df, "k").collect()}
    assert statistics.median([got[3], 100.0]) == 100.0 and got[8] == 95.0
    assert [got[i] for i in (0, 1, 2, 5, 6, 7)] == [100.0, None, 110.0, 120.0, 130.0, 90.0]


def test_records_of_one_view_share_what_its_facts_say(spark, monkeypatch):
    asked = []
    for name in ("revenue_set_aside", "to_common_set_aside", "to_common_contradicted", "bank_revenue_parts", "foreign_filings"):
        rule = getattr(fx, name)
        monkeypatch.setattr(fx, name, lambda facts, name=name, rule=rule: (asked.append(name), rule(facts))[1])
    facts = spark.createDataFrame([_fact("a", "Revenues", 10.0), _fact("a", "NetIncomeLoss", 2.0)], FACT)
    rows = collect.quarterly_record(facts, reg.registry(spark), ["revenue", "net_income", "net_income_to_common", "eps_basic", "eps_diluted", "weighted_avg_shares_basic", "weighted_avg_shares_diluted",
                                                                  "shares_outstanding", "total_equity", "total_assets", "cost_of_revenue", "long_term_debt", "short_term_debt"])
    assert "revenue" in rows.columns and sorted(asked) == sorted(set(asked)) and len(asked) == 5
