import pytest

from finstrata.operators import ratios as rat

YEAR = dict(ticker="AAA", sector_class="general", revenue=1000.0, net_income=150.0, operating_income=200.0, gross_profit=400.0, operating_cash_flow=250.0,
            capex=50.0, depreciation_amortization=40.0, total_assets=2000.0, total_equity=800.0, long_term_debt=300.0, short_term_debt=100.0,
            cash_and_equivalents=120.0, interest_expense=20.0, income_tax_expense=50.0, pretax_income=200.0, current_assets=600.0,
            current_liabilities=300.0, accounts_receivable=100.0, inventory=80.0, cost_of_revenue=600.0)


def run(spark, **change):
    row = {**YEAR, **change}
    schema = ", ".join(f"{k} {'string' if isinstance(YEAR[k], str) else 'double'}" for k in row)
    return rat.ratios(spark.createDataFrame([tuple(row.values())], schema), keep=["ticker"]).first()


def test_worked_year(spark):
    r = run(spark)
    want = dict(ebitda=240, free_cash_flow=200, total_debt=400, net_debt=280, working_capital=300, invested_capital=1080, nopat=150,
                interest_coverage=10, gross_margin=0.4, roe=150 / 800, days_sales_outstanding=36.5)
    for k, v in want.items():
        assert r[k] == pytest.approx(v), k


@pytest.mark.parametrize("field,metric", [("interest_expense", "interest_coverage"), ("inventory", "inventory_turnover"), ("total_equity", "roe"), ("revenue", "net_margin")])
def test_zero_and_missing_denominators_give_null(spark, field, metric):
    assert run(spark, **{field: 0.0})[metric] is None
    assert run(spark, **{field: None})[metric] is None


def test_missing_parts(spark):
    assert run(spark, operating_income=None)["ebitda"] == pytest.approx(150 + 40 + 20 + 50)
    assert run(spark, capex=None)["free_cash_flow"] == 250
    assert run(spark, long_term_debt=None, short_term_debt=None)["total_debt"] is None
    assert run(spark, income_tax_expense=0.0)["nopat"] == pytest.approx(200 * 0.79)
    assert run(spark, cash_and_equivalents=5000.0)["invested_capital"] is None


def test_sector_overlay(spark):
    bank = run(spark, sector_class="bank")
    assert bank["ebitda"] is None and bank["roe"] is not None and bank["free_cash_flow"] is None
    reit = run(spark, sector_class="reit")
    assert reit["ffo"] == 190 and reit["roic"] is None and set(reit["basis"]) == {"ffo", "affo"}
