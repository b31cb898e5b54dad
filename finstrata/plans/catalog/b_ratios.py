"""RAT and the period operators."""

from pyspark.sql import functions as F

from finstrata.operators import periods, ratios
from finstrata.plans.catalog._core import query
from finstrata.plans.standin import FLOWS

_DEBT = "CASE WHEN coalesce(long_term_debt, short_term_debt, commercial_paper) IS NOT NULL THEN coalesce(long_term_debt,0)+coalesce(short_term_debt,0)+coalesce(commercial_paper,0) END"
_CAP = f"CASE WHEN total_equity + ({_DEBT}) - coalesce(cash_and_equivalents,0) > 0 THEN total_equity + ({_DEBT}) - coalesce(cash_and_equivalents,0) END"
_EBITDA = "coalesce(operating_income + depreciation_amortization, net_income + depreciation_amortization + coalesce(interest_expense,0) + coalesce(income_tax_expense,0))"
_NOPAT = "operating_income * (1 - CASE WHEN pretax_income > 0 AND income_tax_expense <> 0 THEN greatest(0, least(income_tax_expense / pretax_income, 0.5)) ELSE 0.21 END)"
_FCF = "operating_cash_flow - coalesce(abs(capex), 0)"
_NETDEBT = f"({_DEBT}) - coalesce(cash_and_equivalents,0) - coalesce(short_term_investments,0)"


def _pos(a, b):
    return f"CASE WHEN ({b}) > 0 THEN ({a}) / ({b}) END"


_GP = "coalesce(gross_profit, revenue - cost_of_revenue)"
_SQL = {
    "ebitda": _EBITDA, "ebit": "operating_income", "nopat": _NOPAT, "free_cash_flow": _FCF,
    "fcf_margin": _pos(_FCF, "revenue"), "levered_fcf": _FCF, "total_debt": _DEBT, "net_debt": _NETDEBT,
    "working_capital": "current_assets - current_liabilities", "invested_capital": _CAP, "roic": _pos(_NOPAT, _CAP),
    "roa": _pos("net_income", "total_assets"), "roe": _pos("net_income", "total_equity"),
    "interest_coverage": _pos("operating_income", "interest_expense"), "debt_to_ebitda": _pos(_DEBT, _EBITDA),
    "asset_turnover": _pos("revenue", "total_assets"), "inventory_turnover": _pos("cost_of_revenue", "inventory"),
    "receivables_turnover": _pos("revenue", "accounts_receivable"),
    "days_sales_outstanding": _pos("365.0", _pos("revenue", "accounts_receivable")),
    "days_inventory_outstanding": _pos("365.0", _pos("cost_of_revenue", "inventory")),
    "gross_margin": _pos(_GP, "revenue"), "operating_margin": _pos("operating_income", "revenue"),
    "net_margin": _pos("net_income", "revenue"), "ebitda_margin": _pos(_EBITDA, "revenue"),
}
_EV = f"market_cap + coalesce({_NETDEBT}, 0)"
_MARKET = {
    "enterprise_value": _EV, "ev_to_ebitda": _pos(_EV, _EBITDA), "ev_to_revenue": _pos(_EV, "revenue"),
    "ev_to_fcf": _pos(_EV, _FCF), "fcf_yield": _pos(_FCF, "market_cap"),
}
_SECTOR = {
    "net_interest_margin": ("bank", _pos("net_interest_income", "total_assets")),
    "efficiency_ratio": ("bank", _pos("noninterest_expense", "net_interest_income + noninterest_income")),
    "loan_to_deposit": ("bank", _pos("total_loans", "total_deposits")),
    "loss_ratio": ("insurance", _pos("claims_incurred", "premiums_earned")),
    "combined_ratio": ("insurance", _pos("benefits_and_expenses", "premiums_earned")),
    "ffo": ("reit", "net_income + depreciation_amortization"),
    "affo": ("reit", "net_income + depreciation_amortization - capex"),
    "ffo_per_share": ("reit", _pos("net_income + depreciation_amortization", "weighted_avg_shares_diluted")),
    "ffo_payout": ("reit", _pos("dividends_paid", "net_income + depreciation_amortization")),
}
# RAT item -> the ratios it covers.
_ITEMS = {
    "rat1_ebitda": ["ebitda"], "rat2_ebit": ["ebit"], "rat3_nopat": ["nopat"],
    "rat4_free_cash_flow": ["free_cash_flow", "levered_fcf"], "rat5_fcf_margin": ["fcf_margin"],
    "rat6_total_debt": ["total_debt"], "rat7_net_debt": ["net_debt"], "rat8_working_capital": ["working_capital"],
    "rat9_invested_capital": ["invested_capital"], "rat10_returns": ["roic", "roa", "roe"],
    "rat11_interest_coverage": ["interest_coverage"], "rat12_debt_to_ebitda": ["debt_to_ebitda"],
    "rat13_turnovers": ["asset_turnover", "inventory_turnover", "receivables_turnover"],
    "rat14_days_outstanding": ["days_sales_outstanding", "days_inventory_outstanding"],
    "rat15_gross_margin": ["gross_margin"], "rat16_margins": ["operating_margin", "net_margin", "ebitda_margin"],
}


def _generic(name, cols):
    sql = "SELECT ticker, fiscal_year, " + ", ".join(f"{_SQL[c]} AS {c}" for c in cols) + " FROM si_annual"

    @query(name, sql, r=" ".join(cols))
    def build(u):
        return ratios.ratios(u.annual, sector_col=None, keep=["ticker", "fiscal_year"]).select(
            "ticker", "fiscal_year", *cols)


for _n, _c in _ITEMS.items():
    _generic(_n, _c)

_WITH_MARKET = """
FROM si_annual a JOIN si_company c ON a.ticker = c.ticker
LEFT JOIN (SELECT ticker, max_by(market_cap, collected_at) AS market_cap FROM si_snapshots GROUP BY ticker) s ON a.ticker = s.ticker"""


def _annual_market(u):
    caps = u.snapshots.groupBy("ticker").agg(F.max_by("market_cap", "collected_at").alias("market_cap"))
    return u.annual.join(u.company.select("ticker", "sector_class"), "ticker").join(caps, "ticker", "left")


def _market(name, cols):
    sql = "SELECT a.ticker, fiscal_year, " + ", ".join(f"{_MARKET[c]} AS {c}" for c in cols) + _WITH_MARKET

    @query(name, sql, r=" ".join(cols))
    def build(u):
        return ratios.ratios(_annual_market(u), sector_col=None, market_cap=F.col("market_cap"),
                             keep=["ticker", "fiscal_year"]).select("ticker", "fiscal_year", *cols)


_market("rat17_enterprise_value", ["enterprise_value"])
_market("rat18_ev_multiples", ["ev_to_ebitda", "ev_to_revenue", "ev_to_fcf", "fcf_yield"])


def _sector(name, sector):
    cols = ratios.SECTOR[sector]
    sql = ("SELECT a.ticker, fiscal_year, " + ", ".join(f"{_SECTOR[c][1]} AS {c}" for c in cols)
           + f" FROM si_annual a JOIN si_company c ON a.ticker = c.ticker WHERE sector_class = '{sector}'")

    @query(name, sql, r=" ".join(cols))
    def build(u):
        rows = _annual_market(u).where(F.col("sector_class") == sector)
        return ratios.ratios(rows, keep=["ticker", "fiscal_year"]).select("ticker", "fiscal_year", *cols)


_sector("rat19_bank", "bank")
_sector("rat20_insurer", "insurance")
_sector("rat21_reit", "reit")


def _overlay(name):
    for key, expr in {**_SQL, **_MARKET}.items():
        off = [s for s, names in ratios.SUPPRESSED.items() if key in names]
        yield (f"CASE WHEN sector_class NOT IN ({', '.join(repr(s) for s in off)}) THEN {expr} END" if off else expr) + f" AS {key}"
    for key, (s, expr) in _SECTOR.items():
        yield f"CASE WHEN sector_class = '{s}' THEN {expr} END AS {key}"


_ALL = list(_SQL) + list(_MARKET) + list(_SECTOR)


@query("rat22_sector_overlay",
       "SELECT *, CAST((net_interest_margin IS NOT NULL)::INT + (combined_ratio IS NOT NULL)::INT + (ffo IS NOT NULL)::INT + (affo IS NOT NULL)::INT AS INT) AS n_notes FROM ("
       + "SELECT a.ticker, fiscal_year, sector_class, " + ", ".join(_overlay("x")) + _WITH_MARKET + ") o",
       r=" ".join(_ALL))
def rat22(u):
    full = ratios.ratios(_annual_market(u), market_cap=F.col("market_cap"), keep=["ticker", "fiscal_year", "sector_class"])
    return full.select("ticker", "fiscal_year", "sector_class", *_ALL, F.size("basis").alias("n_notes"))


# ---- period operators

_TTM_FLOWS = ["revenue", "net_income", "operating_cash_flow", "capex", "dividends_paid"]


@query("res26_ttm", """
SELECT ticker, period_end, fiscal_year, fiscal_quarter, revenue, net_income, operating_cash_flow, capex, dividends_paid,
       weighted_avg_shares_diluted, eps_diluted, total_equity FROM (
SELECT ticker, period_end, fiscal_year, fiscal_quarter, """ + ", ".join(
    f"CASE WHEN count({c}) OVER w = 4 THEN sum({c}) OVER w END AS {c}" for c in _TTM_FLOWS) + """,
  CASE WHEN count(weighted_avg_shares_diluted) OVER w = 4 THEN avg(weighted_avg_shares_diluted) OVER w END AS weighted_avg_shares_diluted,
  CASE WHEN count(eps_diluted) OVER w = 4 THEN sum(eps_diluted) OVER w END AS eps_diluted, total_equity,
  count(*) OVER w AS n, date_diff('day', lag(period_end, 1) OVER o, period_end) AS d1,
  date_diff('day', lag(period_end, 2) OVER o, lag(period_end, 1) OVER o) AS d2,
  date_diff('day', lag(period_end, 3) OVER o, lag(period_end, 2) OVER o) AS d3
FROM si_quarterly WINDOW o AS (PARTITION BY ticker ORDER BY period_end),
     w AS (PARTITION BY ticker ORDER BY period_end ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) t
WHERE n = 4 AND d1 BETWEEN 80 AND 120 AND d2 BETWEEN 80 AND 120 AND d3 BETWEEN 80 AND 120
""", r="eps_diluted weighted_avg_shares_diluted")
def res26(u):
    return periods.compute_ttm(u.quarterly, _TTM_FLOWS, ["total_equity"], ["weighted_avg_shares_diluted"], ["eps_diluted"])


# A month-end row without flows is put inside every quarter that has an event; those step over.
@query("res27_inside_quarter", """
WITH extra AS (SELECT ticker, CAST(date_trunc('month', date) + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE) AS period_end, CAST(NULL AS DOUBLE) AS revenue FROM si_splits GROUP BY ALL),
q AS (SELECT ticker, period_end, revenue FROM si_quarterly UNION ALL
      SELECT e.* FROM extra e ANTI JOIN si_quarterly q ON e.ticker = q.ticker AND e.period_end = q.period_end),
m AS (SELECT q.*, (SELECT max(b.period_end) FROM si_quarterly b WHERE b.ticker = q.ticker AND b.period_end < q.period_end) AS before,
             (SELECT min(b.period_end) FROM si_quarterly b WHERE b.ticker = q.ticker AND b.period_end > q.period_end) AS after FROM q)
SELECT ticker, period_end, revenue FROM m
WHERE revenue IS NOT NULL OR before IS NULL OR after IS NULL OR NOT date_diff('day', before, after) BETWEEN 80 AND 120
""")
def res27(u):
    extra = u.splits.select("ticker", F.last_day("date").alias("period_end")).distinct()
    base = u.quarterly.select("ticker", "period_end", "revenue")
    extra = extra.join(base, ["ticker", "period_end"], "left_anti").withColumn("revenue", F.lit(None).cast("double"))
    return periods.drop_inside_quarter(base.unionByName(extra), ["revenue"])


@query("res1_period_kind", """
SELECT ticker, CASE WHEN l_flag THEN 'instant' WHEN d BETWEEN 350 AND 380 THEN 'year' WHEN d BETWEEN 80 AND 120 THEN 'quarter' ELSE 'other' END AS kind,
       count(*) AS n
FROM (SELECT ticker, form = '10-K/A' AS l_flag, date_diff('day', start, CASE form WHEN '10-Q' THEN CAST(start + INTERVAL 3 MONTH AS DATE) ELSE "end" END) AS d FROM si_facts) f
GROUP BY ALL
""")
def res1(u):
    f = (u.facts.withColumn("end", F.when(F.col("form") == "10-Q", F.add_months("start", 3)).otherwise(F.col("end")))
         .withColumn("start", F.when(F.col("form") != "10-K/A", F.col("start"))))
    return f.groupBy("ticker", periods.period_kind("start", "end").alias("kind")).agg(F.count("*").alias("n"))


@query("res2_fiscal_year", """
SELECT ticker, CAST(year(date) - CASE WHEN month(date) = 1 AND day(date) <= 7 THEN 1 ELSE 0 END AS INT) AS fiscal_year, count(*) AS n
FROM si_bars GROUP BY ALL
""")
def res2(u):
    return u.bars.groupBy("ticker", periods.fiscal_year_of("date").alias("fiscal_year")).agg(F.count("*").alias("n"))


@query("res18_calendar", """
SELECT ticker, date, CAST(CASE WHEN frame LIKE 'CY____%' THEN substr(frame, 3, 4) ELSE CAST(year(date - 180) AS VARCHAR) END AS INT) AS calendar_year,
       CAST(CASE WHEN frame LIKE 'CY____Q_%' THEN CAST(substr(frame, 8, 1) AS INT) ELSE quarter(date - 45) END AS INT) AS calendar_quarter
FROM (SELECT ticker, date, CASE WHEN ratio = 2 THEN 'CY' || CAST(year(date) AS VARCHAR) || 'Q' || CAST(quarter(date) AS VARCHAR) || 'I'
             WHEN ratio = 3 THEN 'CY' || CAST(year(date) AS VARCHAR) END AS frame FROM si_splits) s
""")
def res18(u):
    frame = (F.when(F.col("ratio") == 2, F.concat(F.lit("CY"), F.year("date"), F.lit("Q"), F.quarter("date"), F.lit("I")))
             .when(F.col("ratio") == 3, F.concat(F.lit("CY"), F.year("date"))))
    year, quarter = periods.calendar_from_frame(frame)
    return u.splits.select("ticker", "date",
                           F.coalesce(year, periods.calendar_year_by_rule("date")).alias("calendar_year"),
                           F.coalesce(quarter, periods.calendar_quarter_by_rule("date")).alias("calendar_quarter"))


@query("res19_derived_identities", """
SELECT ticker, period_end, coalesce(rev, net_interest_income + noninterest_income) AS revenue,
       coalesce(total_liabilities, total_assets - total_equity) AS total_liabilities,
       coalesce(gross_profit, coalesce(rev, net_interest_income + noninterest_income) - cost_of_revenue) AS gross_profit,
       CAST((rev IS NULL AND net_interest_income IS NOT NULL)::INT + (total_liabilities IS NULL)::INT
            + (gross_profit IS NULL AND coalesce(rev, net_interest_income) IS NOT NULL)::INT AS INT) AS n_derived
FROM (SELECT *, CASE WHEN interest_expense IS NOT NULL THEN revenue END AS rev FROM si_quarterly) q
""")
def res19(u):
    q = u.quarterly.withColumn("revenue", F.when(F.col("interest_expense").isNotNull(), F.col("revenue")))
    d = periods.derive_identities(q)
    return d.select("ticker", "period_end", "revenue", "total_liabilities", "gross_profit", F.size("derived").alias("n_derived"))


@query("res22_ended_years", """
SELECT a.ticker, a.fiscal_year, a.revenue FROM si_annual_cal a
JOIN (SELECT ticker, max(filed) AS filed FROM si_facts WHERE form = '10-K' AND filed < DATE '2001-06-01' GROUP BY ticker) f
  ON a.ticker = f.ticker WHERE a.period_end <= f.filed
""")
def res22(u):
    known = u.facts.where((F.col("form") == "10-K") & (F.col("filed") < F.lit("2001-06-01").cast("date")))
    return periods.ended_years(u.annual_cal, known).select("ticker", "fiscal_year", "revenue")
