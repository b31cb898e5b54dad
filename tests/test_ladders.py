"""Worked cases of FCT-12, RES-15..17, MKT-8, SRC-12 and the landing stream."""

import datetime as dt

import pytest

from finstrata.operators import displaced, ladders, market
from finstrata.sources import files
from finstrata.streaming import bars_stream, store_bars

FACT = "ticker string, tag string, unit string, start date, end date, val double, accn string, form string, filed date"


def d(text):
    return dt.date.fromisoformat(text)


def year(tag, val, accn, filed, y=2023, end="12-31", form="10-K"):
    return ("A", tag, "USD", d(f"{y}-01-01"), d(f"{y}-{end}"), float(val), accn, form, d(filed))


WHOLE, PART = "DepreciationAndAmortization", "DepreciationDepletionAndAmortization"


def displace(spark, rows):
    out = displaced.da_totals_displaced(spark.createDataFrame(rows, FACT)).collect()
    return sorted((r["tag"], r["accn"], r["end"].isoformat(), r["val"]) for r in out)


def test_a_part_gives_way_from_the_filing_that_shows_it(spark):
    rows = [year(WHOLE, 3366, "k24", "2024-02-20"), year(WHOLE, 3366, "k26", "2026-02-20"), year(PART, 2800, "k26", "2026-02-20"),
            year(WHOLE, 3746, "k26", "2026-02-20", 2025), year(PART, 3000, "k26", "2026-02-20", 2025), year(PART, 2500, "k23", "2023-02-20", 2022), year(WHOLE, 3100, "k23", "2023-02-20", 2022)]
    got = displace(spark, rows)
    assert (PART, "k26", "2023-12-31", 3366.0) in got and (PART, "k26", "2025-12-31", 3746.0) in got
    assert (PART, "k23", "2022-12-31", 2500.0) in got  # filed before it was shown
    assert len(got) == len(rows)


def test_a_part_beside_a_figure_no_larger_than_amortization_stays(spark):
    rows = [year(WHOLE, 300, "k1", "2022-02-01", 2021), year(WHOLE, 300, "k2", "2023-02-01", 2021), year(PART, 200, "k2", "2023-02-01", 2021),
            year(WHOLE, 130, "k3", "2025-02-01", 2024), year(PART, 116, "k3", "2025-02-01", 2024), year("AdjustmentForAmortization", 338, "k3", "2025-02-01", 2024)]
    assert (PART, "k3", "2024-12-31", 116.0) in displace(spark, rows)


def test_a_part_alone_gives_way_to_a_larger_total_given_before(spark):
    rows = [year(WHOLE, 1636, "k18", "2018-02-01", 2017), year(WHOLE, 1636, "k19", "2019-02-01", 2017), year(PART, 769, "k19", "2019-02-01", 2017), year(PART, 760, "k20", "2020-02-01", 2017)]
    got = displace(spark, rows)
    assert not [x for x in got if x[0] == PART and x[1] == "k20"] and (PART, "k19", "2017-12-31", 1636.0) in got


def test_periods_to_date_are_read_so_all_or_none(spark):
    base = [year(WHOLE, 1636, "k18", "2018-02-01", 2017), year(WHOLE, 1636, "k19", "2019-02-01", 2017), year(PART, 769, "k19", "2019-02-01", 2017)]
    quarter = [year(PART, 245, "q1", "2019-05-01", 2019, "03-31", "10-Q"), year(WHOLE, 416, "q1", "2019-05-01", 2019, "03-31", "10-Q")]
    half = [year(PART, 500, "q2", "2019-08-01", 2019, "06-30", "10-Q")]
    assert (PART, "q1", "2019-03-31", 416.0) in displace(spark, base + quarter)
    assert (PART, "q1", "2019-03-31", 245.0) in displace(spark, base + quarter + half)


RUNG = "ticker string, field string, start date, end date, filed date, val double, is_count boolean"


def test_rungs_go_onto_the_annual_figures_basis(spark):
    rows = [("A", "n", d("2020-01-01"), d("2020-09-30"), d("2020-10-30"), 500.0, True), ("A", "n", d("2020-01-01"), d("2020-12-31"), d("2023-02-01"), 10_100.0, True),
            ("A", "e", d("2020-01-01"), d("2020-09-30"), d("2020-10-30"), 40.0, False), ("A", "e", d("2020-01-01"), d("2020-12-31"), d("2023-02-01"), 2.1, False),
            ("A", "n", d("2021-01-01"), d("2021-03-31"), d("2021-04-30"), 505.0, True), ("B", "n", d("2020-01-01"), d("2020-09-30"), d("2020-10-30"), 7.0, True)]
    splits = spark.createDataFrame([("A", d("2022-07-01"), 20.0)], "ticker string, through date, ratio double")
    got = {(r["ticker"], r["field"], r["end"].isoformat()): (r["val"], r["level"]) for r in ladders.rungs_on_year_basis(spark.createDataFrame(rows, RUNG), splits).collect()}
    assert got[("A", "n", "2020-09-30")] == (10_000.0, 20.0) and got[("A", "e", "2020-09-30")] == (2.0, 20.0)
    assert got[("A", "n", "2021-03-31")] == (505.0, 1.0) and got[("B", "n", "2020-09-30")] == (7.0, 1.0)


def scale(spark, rungs, eps):
    r = spark.createDataFrame([("A", d("2021-01-01"), d(e), v) for e, v in rungs], "ticker string, start date, end date, val double")
    key = "ticker string, start date, end date, val double"
    income = spark.createDataFrame([("A", d("2021-01-01"), d(e), 7500.0) for e, _ in rungs], key)
    per = spark.createDataFrame([("A", d("2021-01-01"), d(e), v) for e, v in eps], key)
    return {x["end"].isoformat()[5:7]: x["val"] for x in ladders.rungs_on_one_scale(r, income, per).collect()}


def test_a_count_in_millions_takes_its_years_scale(spark):
    q3, q4 = "2021-09-30", "2021-12-31"
    assert scale(spark, [(q3, 751_900_000.0), (q4, 751.8)], [(q3, 7500 / 751_900_000), (q4, 7500 / 751_800_000)])["12"] == pytest.approx(751_800_000)
    assert scale(spark, [(q3, 751_900_000.0), (q4, 751.8)], [(q3, 7500 / 751_900_000)])["12"] == pytest.approx(751_800_000)
    off = scale(spark, [(q3, 750.0), (q4, 760.0)], [(q3, 7500 / 750_000.0)])  # EPS is off: no other rung is near
    assert off == {"09": 750.0, "12": 760.0}


def debt(spark, rows, annual, quarters):
    facts = spark.createDataFrame([("A", tag, "USD", None, d(end), val, accn, form, d(filed)) for tag, end, val, accn, form, filed in rows], FACT)
    y = spark.createDataFrame([("A", d(e), v, t) for e, v, t in annual], "ticker string, period_end date, long_term_debt double, tag string")
    q = spark.createDataFrame([("A", d(e), v, s) for e, v, s in quarters], "ticker string, period_end date, long_term_debt double, short_term_debt double")
    return {r["period_end"].isoformat(): (r["long_term_debt"], r["tag"]) for r in ladders.quarter_debt_lines(facts, y, q).collect()}


def test_a_quarters_line_is_known_by_its_year_end_column(spark):
    rows = [("LongTermNotesPayable", "2023-05-31", 86.0, "k", "10-K", "2023-06-20"), ("LongTermNotesAndLoans", "2023-05-31", 86.0, "q", "10-Q", "2023-09-11"),
            ("LongTermNotesAndLoans", "2023-08-31", 82.0, "q", "10-Q", "2023-09-11"), ("DebtInstrumentFaceAmount", "2023-05-31", 86.0, "q", "10-Q", "2023-09-11"),
            ("DebtInstrumentFaceAmount", "2023-08-31", 99.0, "q", "10-Q", "2023-09-11")]
    year_end = [("2023-05-31", 86.0, "LongTermNotesPayable")]
    assert debt(spark, rows, year_end, [("2023-08-31", None, 5.0)]) == {"2023-08-31": (82.0, "LongTermNotesAndLoans")}
    assert debt(spark, rows, year_end, [("2023-08-31", 1.0, None)]) == {} and debt(spark, rows, [("2023-05-31", 0.0, "LongTermNotesPayable")], [("2023-08-31", None, None)]) == {}
    whole = [(t.replace("LongTermNotesAndLoans", "SeniorNotes"), *x) for t, *x in rows]
    assert debt(spark, whole, year_end, [("2023-08-31", None, 5.0)]) == {} and debt(spark, whole, year_end, [("2023-08-31", None, 0.0)]) == {"2023-08-31": (82.0, "SeniorNotes")}
    mature = [*whole, ("LongTermDebtCurrent", "2023-05-31", 4.0, "k", "10-K", "2023-06-20")]
    assert debt(spark, mature, year_end, [("2023-08-31", None, 5.0)]) == {"2023-08-31": (82.0, "SeniorNotes")}
    assert debt(spark, [*rows, ("SeniorNotes", "2023-05-31", 86.0, "q", "10-Q", "2023-09-11"), ("SeniorNotes", "2023-08-31", 70.0, "q", "10-Q", "2023-09-11")], year_end, [("2023-08-31", None, 0.0)]) == {}


def test_a_zero_rate_counts(spark):
    s = spark.createDataFrame([("fred:10y", d("2020-01-01"), 0.5), ("fred:10y", d("2020-01-02"), 0.0), ("fred:10y", d("2020-01-03"), None)], "series string, date date, value double")
    assert market.risk_free(s).first()["rate"] == 0.0


def test_index_sheet_with_lines_above_the_header(spark, tmp_path):
    label = {v: k for k, v in files.INDEX_LABELS.items()}
    names = ["Date", *label.values()]
    (tmp_path / "i.csv").write_text('"Stock market, monthly"\nsource,x,y\n' + ",".join(names) + "\n" + ",".join(["2020.01", *["1.5"] * len(label)]) + "\nnotes\n")
    got = files.read_monthly_index(spark, str(tmp_path / "i.csv")).collect()
    assert len(got) == len(label) and {r["date"] for r in got} == {d("2020-01-01")} and {r["value"] for r in got} == {1.5}
    (tmp_path / "j.csv").write_text("Date,only\n2020.01,3\n")
    with pytest.raises(ValueError):
        files.read_monthly_index(spark, str(tmp_path / "j.csv"))


def test_bars_land_as_a_stream(spark, tmp_path):
    bar = lambda t, day, c: f'{{"ticker":"{t}","date":"{day}","open":1,"high":1,"low":1,"close":{c},"volume":1}}\n'
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(bar("A", "2020-01-02", 5) + bar("A", "2020-01-03", 6) + bar("A", "2020-01-03", 6))
    stored = spark.createDataFrame([("A", d("2020-01-01"), 1.0, 1.0, 1.0, 3.0, 1.0), ("A", d("2020-01-02"), 1.0, 1.0, 1.0, 4.0, 1.0), ("B", d("2020-01-05"), 1.0, 1.0, 1.0, 9.0, 1.0)],
                                   "ticker string, date date, open double, high double, low double, close double, volume double")
    seen = []
    store_bars(bars_stream(spark, str(tmp_path / "in")), lambda: stored, lambda df, i: seen.append(df.collect()), str(tmp_path / "ck")).awaitTermination()
    assert sorted((r["ticker"], r["date"].day, r["close"]) for r in seen[0]) == [("A", 1, 3.0), ("A", 2, 5.0), ("A", 3, 6.0), ("B", 5, 9.0)]
