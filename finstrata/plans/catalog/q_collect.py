"""The collect path end to end, and vintages (RES-25): facts made from known statements with disturbances that cleaning must undo."""

from pyspark.sql import functions as F

from finstrata import registry as reg
from finstrata.operators import displaced
from finstrata.plans import collect, standin
from finstrata.plans.catalog._core import query

R = standin.RELATIONS
FIELDS = ["revenue", "cost_of_revenue", "gross_profit", "net_income", "operating_cash_flow", "depreciation_amortization", "dividends_paid", "total_assets", "total_equity", "total_liabilities",
          "long_term_debt", "weighted_avg_shares_diluted", "eps_diluted", "weighted_avg_shares_basic", "eps_basic", "shares_outstanding", "short_term_debt"]

# Statements to date at each quarter's end; depreciation and amortisation stand apart.
R["si_path"] = """
SELECT q.ticker, q.fiscal_year AS fy, q.fiscal_quarter AS fq, q.period_end, CAST(date_trunc('year', q.period_end) AS DATE) AS start, c.company_no,
  sum(revenue) OVER w AS revenue, sum(cost_of_revenue) OVER w AS cost, sum(net_income) OVER w AS net, sum(operating_cash_flow) OVER w AS ocf,
  sum(floor(depreciation_amortization * 0.6)) OVER w AS dep, sum(depreciation_amortization - floor(depreciation_amortization * 0.6)) OVER w AS amort,
  total_assets, total_equity, long_term_debt, weighted_avg_shares_diluted AS shares,
  concat(q.ticker, '-', CAST(q.fiscal_year AS VARCHAR(4)), '-', CAST(q.fiscal_quarter AS VARCHAR(1))) AS accn, CASE WHEN q.fiscal_quarter = 4 THEN '10-K' ELSE '10-Q' END AS form,
  CAST(q.period_end + INTERVAL 50 DAY AS DATE) AS filed
FROM si_quarterly q JOIN si_company c ON c.ticker = q.ticker WINDOW w AS (PARTITION BY q.ticker, q.fiscal_year ORDER BY q.fiscal_quarter)
"""
R["si_path_years"] = "SELECT * FROM si_path WHERE fq = 4"


def _own(tag, value, unit="USD", instant=False, where="true", rel="si_path"):
    return f"""SELECT ticker, '{tag}' AS tag, '{unit}' AS unit, {'CAST(NULL AS DATE)' if instant else 'start'} AS start, period_end AS "end", CAST({value} AS DOUBLE) AS val, accn, form, filed FROM {rel} WHERE {where}"""


def _again(tag, value, years, where="true"):
    """A year's figure in the annual report of some years later."""
    return f"""SELECT y.ticker, '{tag}', 'USD', y.start, y.period_end, CAST({value} AS DOUBLE), k.accn, k.form, k.filed FROM si_path_years y JOIN si_path_years k ON k.ticker = y.ticker AND k.fy = y.fy + {years} WHERE {where}"""


_WRONG = "(y.company_no + y.fy) % 4 = 0 AND y.fy BETWEEN 1994 AND 1995"
_THOUSANDS = "(company_no + fy) % 5 = 0 AND net <> 0"
# Disturbances: counts in thousands, a year's sales restated in thousands two years on, a filing in another currency, a figure of the year ahead.
R["si_f_path"] = "\nUNION ALL ".join([
    _own("Revenues", "revenue"), _own("CostOfRevenue", "cost"), _own("NetIncomeLoss", "net"), _own("NetCashProvidedByUsedInOperatingActivities", "ocf"),
    _own(displaced.DEPRECIATION, "dep"), _own(displaced.AMORTIZATION[0], "amort"), _own("Assets", "total_assets", instant=True), _own("StockholdersEquity", "total_equity", instant=True),
    _own("LongTermDebtNoncurrent", "long_term_debt", instant=True, where="long_term_debt IS NOT NULL"),
    _own("WeightedAverageNumberOfDilutedSharesOutstanding", f"CASE WHEN {_THOUSANDS} THEN shares / 1000 ELSE shares END", "shares", rel="si_path_years"),
    _own("EarningsPerShareDiluted", "net / shares", "USD/shares", where="net <> 0", rel="si_path_years"),
    *[_again(t, v, 1) for t, v in (("Revenues", "y.revenue"), ("NetIncomeLoss", "y.net"))], _again("NetIncomeLoss", "y.net", 2), _again("Revenues", f"CASE WHEN {_WRONG} THEN y.revenue / 1000 ELSE y.revenue END", 2),
    *[f"""SELECT ticker, '{t}', '{u}', {s}, period_end, CAST({v} AS DOUBLE), concat(accn, 'X'), '10-K/A', CAST(filed + INTERVAL 200 DAY AS DATE) FROM si_path_years WHERE fy % 3 = 0"""
      for t, u, s, v in (("Revenues", "USD", "start", 1), ("Assets", "EUR", "CAST(NULL AS DATE)", 5), ("Liabilities", "EUR", "CAST(NULL AS DATE)", 6))],
    """SELECT ticker, 'PaymentsOfDividends', 'USD', CAST(period_end + INTERVAL 1 DAY AS DATE), CAST(period_end + INTERVAL 1 YEAR AS DATE), CAST(777 AS DOUBLE), accn, form, filed FROM si_path_years""",
])
_K = "CAST(fy AS INT) AS fiscal_year"
_VALUES = """revenue, cost AS cost_of_revenue, revenue - cost AS gross_profit, net AS net_income, ocf AS operating_cash_flow, dep + amort AS depreciation_amortization, total_assets, total_equity,
 total_assets - total_equity AS total_liabilities, long_term_debt"""
_OUT = "revenue cost_of_revenue gross_profit net_income operating_cash_flow depreciation_amortization total_assets total_equity total_liabilities long_term_debt".split()


def clean(u, view):
    return u.shared(f"path_{view}", lambda: collect.clean_facts(u.f_path, view))


def quarterly(u):
    return u.shared("path_quarters", lambda: collect.quarterly_record(u.f_path, reg.registry(u.spark), FIELDS, clean(u, "quarterly")))


@query("path_annual_record", f"""SELECT ticker, {_K}, period_end, {_VALUES}, shares AS weighted_avg_shares_diluted, CASE WHEN net <> 0 THEN net / shares END AS eps_diluted,
 CASE WHEN EXISTS (SELECT 1 FROM si_path_years p WHERE p.ticker = y.ticker AND p.fy = y.fy - 1) THEN CAST(777 AS DOUBLE) END AS dividends_paid,
 coalesce({_WRONG} AND EXISTS (SELECT 1 FROM si_path_years p WHERE p.ticker = y.ticker AND p.fy = y.fy + 2), false) AS restored FROM si_path_years y""", r="eps_diluted weighted_avg_shares_diluted")
def annual(u):
    a = collect.annual_record(u.f_path, reg.registry(u.spark), FIELDS, clean(u, "annual"))
    return a.select("ticker", "fiscal_year", "period_end", *_OUT, "weighted_avg_shares_diluted", "eps_diluted", "dividends_paid",
                    F.coalesce(F.array_contains("repaired", "revenue"), F.lit(False)).alias("restored"))


_SINGLE = {"revenue": "revenue", "cost": "cost", "net": "net", "ocf": "ocf", "dep": "dep", "amort": "amort"}
R["ox_path_q"] = f"""SELECT ticker, period_end, fy, fq, total_assets, total_equity, long_term_debt, {', '.join(f'CASE WHEN fq = 1 THEN {c} WHEN lag(fq) OVER w = fq - 1 THEN {c} - lag({c}) OVER w END AS {c}' for c in _SINGLE)}
 FROM si_path WINDOW w AS (PARTITION BY ticker, fy ORDER BY fq)"""


@query("path_quarterly_record", f"SELECT ticker, period_end, {_K}, CAST(fq AS INT) AS fiscal_quarter, {_VALUES} FROM ox_path_q")
def quarters(u):
    return quarterly(u).select("ticker", "period_end", "fiscal_year", "fiscal_quarter", *_OUT)


@query("path_ttm_record", f"""SELECT ticker, period_end, revenue, net_income, depreciation_amortization, total_assets FROM (SELECT ticker, period_end, fq, total_assets,
 {', '.join(f'CASE WHEN count({v}) OVER w = 4 THEN sum({v}) OVER w END AS {n}' for n, v in (('revenue', 'revenue'), ('net_income', 'net'), ('depreciation_amortization', '(dep + amort)')))},
 date_diff('day', lag(period_end, 3) OVER o, period_end) AS span FROM ox_path_q WINDOW o AS (PARTITION BY ticker ORDER BY period_end), w AS (PARTITION BY ticker ORDER BY period_end ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) x
 WHERE span BETWEEN 250 AND 300""")
def ttm(u):
    return collect.ttm_record(quarterly(u), FIELDS).select("ticker", "period_end", "revenue", "net_income", "depreciation_amortization", "total_assets")


@query("res25_vintage_views", f"""SELECT ticker, {_K}, accn, revenue, net AS net_income, revenue - cost AS gross_profit, dep + amort AS depreciation_amortization, shares AS weighted_avg_shares_diluted FROM si_path_years
UNION ALL SELECT y.ticker, CAST(y.fy AS INT), k.accn, CASE WHEN k.fy = y.fy + 2 AND {_WRONG} THEN y.revenue / 1000 ELSE y.revenue END, y.net, NULL, NULL, NULL FROM si_path_years y JOIN si_path_years k ON k.ticker = y.ticker AND k.fy IN (y.fy + 1, y.fy + 2)""",
       r="revenue weighted_avg_shares_diluted")
def vintages(u):
    v = collect.vintage_views(u.f_path, reg.registry(u.spark), FIELDS, clean(u, "vintage"))
    return v.select("ticker", "fiscal_year", "accn", "revenue", "net_income", "gross_profit", "depreciation_amortization", "weighted_avg_shares_diluted")


@query("path_effects", f"""SELECT rule, action, count(*) AS n FROM (SELECT 'foreign filing' AS rule, 'out' AS action FROM si_f_path WHERE accn LIKE '%X'
 UNION ALL SELECT 'depreciation combined', 'in' FROM si_path WHERE amort > 0) x GROUP BY ALL""")
def effects(u):
    return collect.effects(u.f_path).groupBy("rule", "action").agg(F.count("*").alias("n"))
