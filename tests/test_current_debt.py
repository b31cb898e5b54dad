"""Worked cases of FCT-10 and FCT-11."""

import datetime as dt

import pytest

from finstrata.operators import current_debt as cd

FACT = "ticker string, tag string, unit string, start date, end date, val double, accn string, form string, filed date"
SB, LTC, DC, CP = cd.BORROWINGS, cd.MATURITIES[0], cd.DEBT, cd.PAPER


def facts(spark, *rows):
    day = dt.date.fromisoformat
    return spark.createDataFrame([("A", tag, "USD", None, day(end), float(val), accn, form, day(filed)) for tag, val, end, accn, form, filed in rows], FACT)


def at(end, accn="k", form="10-K", filed="2024-02-01", **tags):
    return [(tag, val, end, accn, form, filed) for tag, val in tags.items()]


def read(df, tag):
    return {(r["accn"], r["end"].isoformat()): r["val"] for r in df.where(df["tag"] == tag).collect()}


Y = "2023-12-31"


@pytest.mark.parametrize("tags,want", [
    ({SB: 0, LTC: 12973}, 12973), ({SB: 1796, LTC: 4510}, 6306),
    ({SB: 5089, LTC: 5059}, None),  # the maturities and a little more
    ({SB: 6787, LTC: 6764, "ShortTermBankLoansAndNotesPayable": 22}, None),  # the maturities and its own parts
    ({SB: 362, LTC: 900, "BankOverdrafts": 362}, 1262),  # its own parts alone
    ({SB: 100, LTC: 60, cd.APART: 500, cd.OWN_TOTAL: 600}, None), ({SB: 100, LTC: 60, cd.APART: 500, cd.OWN_TOTAL: 660}, 160),
    ({SB: 100, LTC: 60, cd.CURRENT: 300, "AccountsPayableCurrent": 150}, None), ({SB: 100, LTC: 60, cd.CURRENT: 300, "AccountsPayableCurrent": 100}, 160),
    ({SB: 40, LTC: 100, cd.MATURITIES[1]: 60}, 100),  # one maturities figure is the other and the borrowings
    ({SB: 40, LTC: 100, DC: 7}, 7), ({SB: 40, LTC: 100, cd.TOTAL: 900}, None),
])
def test_borrowings_and_maturities(spark, tags, want):
    got = read(cd.current_debt_combined(facts(spark, *at(Y, **tags)), "annual"), DC)
    assert got == ({} if want is None else {("k", Y): float(want)})


def test_a_quarter_takes_its_latest_year_ends_word(spark):
    year = [*at(Y, **{SB: 100, LTC: 100, cd.BALANCE_TOTAL: 1000})]
    quarter = at("2024-03-31", "q", "10-Q", "2024-05-01", **{SB: 130, LTC: 90})
    assert ("q", "2024-03-31") not in read(cd.current_debt_combined(facts(spark, *year, *quarter), "quarterly"), DC)
    apart = at(Y, **{SB: 100, LTC: 50, cd.BALANCE_TOTAL: 1000})
    assert read(cd.current_debt_combined(facts(spark, *apart, *quarter), "quarterly"), DC)[("q", "2024-03-31")] == 220


def test_the_latest_filing_decides_a_date(spark):
    later = at(Y, "k2", "10-K", "2025-02-01", **{SB: 60, LTC: 60})
    f = facts(spark, *at(Y, **{SB: 60, LTC: 200}), *later)
    assert read(cd.current_debt_combined(f, "annual"), DC) == {} and read(cd.current_debt_combined(f, "vintage"), DC) == {("k", Y): 260.0}


def test_debt_before_a_refinancing_goes(spark):
    f = facts(spark, *at(Y, **{DC: 12656, cd.REFINANCED: 8250, SB: 4406, CP: 3000}))
    out = cd.current_debt_set_aside(f, "annual")
    assert read(out, DC) == {} and read(out, CP) == {("k", Y): 0.0} and read(out, SB) == {("k", Y): 4406.0}


def test_paper_inside_the_short_term_figure_reads_zero(spark):
    inside = lambda **tags: read(cd.current_debt_set_aside(facts(spark, *at(Y, **tags)), "annual"), CP)[("k", Y)]
    assert inside(**{DC: 50, CP: 40}) == 0 and inside(**{SB: 39.5, CP: 40}) == 0
    assert inside(**{SB: 30, CP: 40}) == 40 and inside(**{DC: 50, CP: 40, LTC: 60}) == 40 and inside(**{CP: 40}) == 40


def test_a_vintage_states_the_latest_paper(spark):
    f = facts(spark, *at(Y, "k1", "10-K", "2024-02-01", **{CP: 40}), *at(Y, "k2", "10-K", "2025-02-01", **{SB: 45}), *at(Y, "k3", "10-K", "2026-02-01", **{LTC: 5}))
    assert read(cd.current_debt_set_aside(f, "vintage"), CP) == {("k1", Y): 40.0, ("k2", Y): 0.0, ("k3", Y): 40.0}


def test_filing_dates_are_read_once(spark):
    f = facts(spark, *at(Y, **{SB: 100, LTC: 60, CP: 40}), *at("2024-03-31", "q", "10-Q", "2024-05-01", **{SB: 90, LTC: 50}))
    aggregates = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("pivot") + df._jdf.queryExecution().optimizedPlan().toString().count("max(CASE WHEN (tag#")
    combined, held = cd.current_debt_combinations(f, "quarterly")
    assert aggregates(combined) == aggregates(held) == 0
    assert aggregates(cd.current_debt_set_aside(f, "quarterly", combined)) == 0


def test_facts_of_no_tag_or_date_pass_by(spark):
    f = facts(spark, *at(Y, **{SB: 100, LTC: 60, CP: 40})).union(spark.createDataFrame([("A", None, "USD", None, None, 7.0, None, None, None), (None, CP, "USD", None, None, 8.0, "z", None, None)], FACT))
    for out in (cd.current_debt_combined(f, "annual"), cd.current_debt_set_aside(f, "annual")):
        assert {7.0, 8.0} <= {r["val"] for r in out.collect()}


def test_figures_move_narrow_and_a_date_has_its_last_form(spark):
    f = facts(spark, *at(Y, **{SB: 100, LTC: 60}), (SB, 110, Y, "k", "10-K/A", "2024-03-01"), *at(Y, "k2", "10-Q", **{SB: 5}))
    dates = cd._by_date(f, cd._NAMES)
    rows = {r["accn"]: (r["sb"], r["m0"], r["form"], r["filed"].isoformat()) for r in dates.collect()}
    assert rows == {"k": (110.0, 60.0, "10-K/A", "2024-03-01"), "k2": (5.0, None, "10-Q", "2024-02-01")}
    plan = dates._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan[plan.index("Exchange"):]


def test_a_total_of_the_date_holds_another_filings_maturities(spark):
    total = at(Y, "k1", **{cd.TOTAL: 900})
    f = facts(spark, *total, *at(Y, "k2", "10-Q", "2024-05-01", **{SB: 40, LTC: 100, cd.MATURITIES[1]: 60}))
    out = cd.current_debt_combined(f, "quarterly")
    assert read(out, DC) == {} and read(out, cd.MATURITIES[1]) == {}
    alone = cd.current_debt_combined(f, "vintage")
    assert read(alone, DC) == {("k2", Y): 100.0} and read(alone, cd.MATURITIES[1]) == {("k2", Y): 60.0}


def test_debt_facts_are_made_as_their_sql_says(spark, tmp_path):
    from finstrata.plans import standin
    from finstrata.plans.catalog import n_current_debt
    day = dt.datetime.fromisoformat
    orders = [(1, day("1995-03-07")), (2, day("1995-03-30")), (3, None), (4, day("1996-12-31")), (4, day("1996-12-31")), (None, day("1995-01-01"))]
    lines = [(o, s, n, q, d) for o in (1, 2, 3, 4, None) for s in (7, None) for n in (1, 2, 6, 7, 9, None) for q in (3.0, 17.5, None) for d in (day("1995-12-31"), day("1996-01-01"), None)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    u = standin.Universe(spark, str(tmp_path))
    made, said = n_current_debt.currentd(u), u.relation("si_f_currentd")
    assert made.schema.simpleString() == said.schema.simpleString() and made.count() == said.count() > 100
    assert made.exceptAll(said).isEmpty() and said.exceptAll(made).isEmpty()
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
