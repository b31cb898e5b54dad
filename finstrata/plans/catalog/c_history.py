"""HIS: the monthly valuation history over the stand-in universe (five-year windows, 36 values at least)."""

from pyspark.sql import functions as F

from finstrata.operators import history as h
from finstrata.operators import periods
from finstrata.plans import standin
from finstrata.plans.catalog._core import query

YEARS = 5
_FLOW = ["revenue", "net_income", "operating_income", "depreciation_amortization", "operating_cash_flow", "capex",
         "interest_expense", "income_tax_expense"]
_POINT = ["total_equity", "long_term_debt", "short_term_debt", "commercial_paper", "cash_and_equivalents",
          "short_term_investments", "weighted_avg_shares_diluted"]


def points(u):
    ttm = periods.compute_ttm(u.quarterly, _FLOW, _POINT)
    filed = (u.facts.where(F.col("form") == "10-K")
             .groupBy("ticker", F.year("end").alias("fiscal_year")).agg(F.min("filed").alias("first_filed")))
    owes = u.annual_cal.groupBy("ticker").agg(
        F.coalesce(F.max("long_term_debt") > 0, F.lit(False)).alias("files_long_term_debt"))
    j = (ttm.join(filed, ["ticker", "fiscal_year"], "left").join(owes, "ticker")
         .join(u.company.select("ticker", "sector_class"), "ticker"))
    j = j.withColumn("known_on", h.known_on(F.col("period_end"), F.col("fiscal_quarter"), F.col("first_filed"),
                                            F.lit("2001-11-30").cast("date")))
    # A quarter in seven lacks its long-term debt, so that the missing-debt rule is exercised.
    thin = F.col("revenue") % 7 == 0
    j = j.withColumn("long_term_debt", F.when(~thin, F.col("long_term_debt")))
    return h.ttm_points(j.withColumnRenamed("weighted_avg_shares_diluted", "shares"))


standin.RELATIONS["ox_points"] = """
SELECT t.ticker, sector_class, t.period_end, shares,
  least(CASE WHEN fiscal_quarter = 4 AND first_filed > t.period_end AND first_filed <= t.period_end + 120 THEN first_filed
             WHEN fiscal_quarter = 4 THEN t.period_end + 75 ELSE t.period_end + 45 END, DATE '2001-11-30') AS known_on,
  net_income AS earnings, revenue, total_equity AS common_equity,
  CASE WHEN capex IS NOT NULL AND sector_class NOT IN ('bank', 'reit') THEN operating_cash_flow - abs(capex) END AS fcf,
  CASE WHEN sector_class NOT IN ('bank', 'insurance') THEN coalesce(operating_income + depreciation_amortization,
       net_income + depreciation_amortization + coalesce(interest_expense, 0) + coalesce(income_tax_expense, 0)) END AS ebitda,
  CASE WHEN NOT (owes AND ltd IS NULL) AND sector_class <> 'bank' AND coalesce(ltd, short_term_debt, commercial_paper) IS NOT NULL
       THEN coalesce(ltd, 0) + coalesce(short_term_debt, 0) + coalesce(commercial_paper, 0)
            - (coalesce(cash_and_equivalents, 0) + coalesce(short_term_investments, 0)) END AS net_debt,
  CASE WHEN sector_class = 'reit' THEN net_income + depreciation_amortization END AS ffo, owes AND ltd IS NULL AS debt_missing
FROM (SELECT *, CASE WHEN revenue % 7 <> 0 THEN long_term_debt END AS ltd FROM (
  SELECT ticker, period_end, fiscal_year, fiscal_quarter, long_term_debt, total_equity, short_term_debt, commercial_paper, cash_and_equivalents,
    short_term_investments, weighted_avg_shares_diluted AS shares, """ + ", ".join(
    f"CASE WHEN count({c}) OVER w = 4 THEN sum({c}) OVER w END AS {c}" for c in _FLOW) + """,
    date_diff('day', lag(period_end, 3) OVER o, period_end) AS d3
  FROM si_quarterly WINDOW o AS (PARTITION BY ticker ORDER BY period_end),
       w AS (PARTITION BY ticker ORDER BY period_end ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) a WHERE d3 < 290) t
LEFT JOIN (SELECT ticker, year("end") AS fy, min(filed) AS first_filed FROM si_facts WHERE form = '10-K' GROUP BY ALL) f
  ON t.ticker = f.ticker AND t.fiscal_year = f.fy
JOIN (SELECT ticker, coalesce(max(long_term_debt) > 0, false) AS owes FROM si_annual_cal GROUP BY ticker) l ON t.ticker = l.ticker
JOIN si_company c ON t.ticker = c.ticker
"""
standin.RELATIONS["ox_months"] = """
SELECT ticker, max(date) AS date, arg_max(close, date) AS close FROM si_bars GROUP BY ticker, date_trunc('month', date)
"""
standin.RELATIONS["ox_known"] = """
SELECT m.ticker, m.date, any_value(m.close) AS close, max(p.period_end) AS latest_period_end
FROM ox_months m LEFT JOIN ox_points p ON p.ticker = m.ticker AND p.known_on <= m.date GROUP BY m.ticker, m.date
"""
standin.RELATIONS["ox_joined"] = """
SELECT k.ticker, k.date, k.close, c.sector_class, k.latest_period_end, date_diff('day', p.known_on, k.date) AS point_age,
  date_diff('day', p.known_on, k.date) <= 200 AS fresh,
  p.period_end, p.shares, p.earnings, p.revenue, p.common_equity, p.fcf, p.ebitda, p.net_debt, p.ffo, p.debt_missing,
  coalesce((SELECT sum(amount) FROM si_dividends d WHERE d.ticker = k.ticker AND d.date > k.date - 365 AND d.date <= k.date), 0) AS ttm_dps
FROM ox_known k JOIN si_company c ON c.ticker = k.ticker
LEFT JOIN ox_points p ON p.ticker = k.ticker AND p.period_end = k.latest_period_end
"""
_M = "close * shares"
_EV = "close * shares + coalesce(net_debt, 0)"
standin.RELATIONS["ox_multiples"] = f"""
SELECT ticker, date, close, sector_class, fresh, latest_period_end, point_age, CASE WHEN fresh THEN period_end END AS ttm_period_end,
  CASE WHEN fresh THEN {_M} END AS market_cap,
  CASE WHEN fresh AND sector_class <> 'bank' AND NOT debt_missing THEN {_EV} END AS enterprise_value,
  CASE WHEN fresh AND earnings > 0 THEN {_M} / earnings END AS pe,
  CASE WHEN fresh AND revenue > 0 THEN {_M} / revenue END AS ps,
  CASE WHEN fresh AND common_equity > 0 THEN {_M} / common_equity END AS pb,
  CASE WHEN fresh AND fcf > 0 AND sector_class NOT IN ('bank', 'reit') THEN {_M} / fcf END AS pfcf,
  CASE WHEN fresh AND ebitda > 0 AND NOT debt_missing AND {_EV} > 0 AND sector_class NOT IN ('bank', 'insurance') THEN ({_EV}) / ebitda END AS ev_ebitda,
  CASE WHEN fresh AND ffo > 0 AND sector_class = 'reit' THEN {_M} / ffo END AS pffo,
  CASE WHEN ttm_dps > 0 THEN ttm_dps / close END AS div_yield,
  shares, earnings, revenue, common_equity, fcf, ebitda, net_debt, ffo, debt_missing, ttm_dps
FROM ox_joined
"""
standin.RELATIONS["ox_stats"] = f"""
SELECT a.ticker, a.date, a.metric, any_value(a.value) AS current, count(b.value) AS n, min(b.date) FILTER (b.value IS NOT NULL) AS window_start,
  CASE WHEN count(b.value) >= 36 THEN min(b.value) END AS min, CASE WHEN count(b.value) >= 36 THEN quantile_cont(b.value, 0.25) END AS p25,
  CASE WHEN count(b.value) >= 36 THEN quantile_cont(b.value, 0.5) END AS median, CASE WHEN count(b.value) >= 36 THEN quantile_cont(b.value, 0.75) END AS p75,
  CASE WHEN count(b.value) >= 36 THEN max(b.value) END AS max,
  CASE WHEN count(b.value) >= 36 AND any_value(a.value) IS NOT NULL THEN count(*) FILTER (b.value <= a.value) / count(b.value) END AS pct_rank
FROM ox_long a JOIN ox_long b ON a.ticker = b.ticker AND a.metric = b.metric AND b.date <= a.date AND b.date > a.date - INTERVAL {YEARS} YEAR
GROUP BY a.ticker, a.date, a.metric
"""
standin.RELATIONS["ox_long"] = " UNION ALL ".join(
    f"SELECT ticker, date, '{m}' AS metric, {m} AS value FROM ox_multiples" for m in h.METRICS)


def _implied(q):
    base = "CASE s.metric WHEN 'pe' THEN earnings WHEN 'ps' THEN revenue WHEN 'pb' THEN common_equity WHEN 'pfcf' THEN fcf WHEN 'ev_ebitda' THEN ebitda ELSE ffo END"
    val = f"(s.{q} * ({base}) - CASE WHEN s.metric = 'ev_ebitda' THEN coalesce(net_debt, 0) ELSE 0 END)"
    return (f"CASE WHEN fresh AND ({base}) > 0 AND {val} > 0 AND NOT (s.metric = 'ev_ebitda' AND debt_missing) "
            f"THEN {val} / shares END")


standin.RELATIONS["ox_implied"] = f"""
SELECT s.ticker, s.date, s.metric, {_implied('p25')} AS low, {_implied('median')} AS mid, {_implied('p75')} AS high
FROM ox_stats s JOIN ox_multiples m ON s.ticker = m.ticker AND s.date = m.date
WHERE s.median IS NOT NULL AND CASE m.sector_class WHEN 'bank' THEN s.metric IN ('pe', 'ps', 'pb')
  WHEN 'insurance' THEN s.metric IN ('pe', 'ps', 'pb', 'pfcf') WHEN 'reit' THEN s.metric IN ('pffo', 'ps', 'pb', 'ev_ebitda')
  ELSE s.metric IN ('pe', 'ps', 'pb', 'pfcf', 'ev_ebitda') END
"""
standin.RELATIONS["ox_value"] = """
SELECT ticker, date, median(mid) AS fair_value, median(low) AS fair_value_low, median(high) AS fair_value_high, CAST(count(*) AS INT) AS fair_value_n
FROM ox_implied WHERE mid IS NOT NULL GROUP BY ticker, date HAVING count(*) >= 2
"""


def months(u):
    return u.shared("month_closes", lambda: h.month_end_closes(u.bars))


def joined(u):
    known = h.latest_known(months(u), points(u))
    # By company alone while the rows still lie by company, then by day.
    return (known.join(u.company.select("ticker", "sector_class"), "ticker")
            .join(h.trailing_dividends(months(u), u.dividends), ["ticker", "date"])
            .select(*known.columns, "ttm_dps", "sector_class"))


def monthly(u):
    """The monthly rows with multiples, once per universe."""
    return u.shared("monthly", lambda: h.multiples(joined(u)))


def _stats(u):
    return u.shared("stats", lambda: h.window_stats(monthly(u), YEARS, latest="latest"))


def stats(u):
    return _stats(u).drop("latest")


def latest(u):
    """The windows, rows and implied values of each company's latest month, which is all that its ranges and value read."""
    rows = u.shared("latest_monthly", lambda: h.latest_month(monthly(u)))
    windows = u.shared("latest_stats", lambda: _stats(u).where("latest").drop("latest"))
    return windows, rows, h.implied_values(windows, rows)


def latest_ranges(u):
    return h.ranges(*latest(u))


def latest_value(u):
    """(ticker, date, close, fair_value) at each company's latest month."""
    value = h.historical_value(latest(u)[2])
    last = monthly(u).groupBy("ticker").agg(F.max("date").alias("date"), F.max_by("close", "date").alias("close"))
    return last.join(value, ["ticker", "date"], "left")


@query("his1_known_on", "SELECT ticker, period_end, known_on FROM ox_points")
def his1(u):
    return points(u).select("ticker", "period_end", "known_on")


@query("his2_month_end_closes", "SELECT * FROM ox_months")
def his2(u):
    return h.month_end_closes(u.bars)


# Odd companies' bars are adjusted for dividends; every company has two factors that are no share splits.
R_ADJ = "CAST(substr(ticker, 2) AS INT) % 2 = 1"
standin.RELATIONS["si_adj_bars"] = f"SELECT ticker, date, close, {R_ADJ} AS dividend_adjusted FROM si_bars"
standin.RELATIONS["si_div_factors"] = "SELECT ticker, date, CAST(1 / (1 + amount / 1000) AS DOUBLE) AS factor FROM si_dividends"
standin.RELATIONS["si_spin_offs"] = """SELECT ticker, DATE '1997-05-20' AS date, CAST(1.281 AS DOUBLE) AS ratio FROM si_company UNION ALL SELECT ticker, DATE '1999-02-10', CAST(1.589 AS DOUBLE) FROM si_company
UNION ALL SELECT ticker, DATE '1998-08-08', CAST(2.0 AS DOUBLE) FROM si_company UNION ALL SELECT ticker, DATE '2035-01-01', CAST(1.77 AS DOUBLE) FROM si_company"""
_PF = "CASE WHEN m.date < DATE '1997-05-20' THEN 1.281 * 1.589 WHEN m.date < DATE '1999-02-10' THEN 1.589 ELSE 1.0 END"


@query("his2_market_closes", f"SELECT m.ticker, m.date, CASE WHEN {R_ADJ.replace('ticker', 'm.ticker')} THEN m.close / coalesce((SELECT product(f.factor) FROM si_div_factors f WHERE f.ticker = m.ticker AND f.date > m.date), 1) ELSE m.close END AS close FROM ox_months m", r="close")
def his2m(u):
    return h.month_end_closes(u.adj_bars, u.div_factors)


@query("his2_since_listing", "SELECT p.ticker, p.period_end FROM ox_points p JOIN (SELECT ticker, min(date) AS f FROM si_bars WHERE date >= DATE '1996-09-01' GROUP BY ticker) b ON b.ticker = p.ticker WHERE p.period_end >= f")
def his2l(u):
    late = u.bars.withColumn("close", F.when(F.col("date") >= F.lit("1996-09-01").cast("date"), F.col("close")))
    return h.since_listing(points(u), late).select("ticker", "period_end")


@query("his6_price_factor", f"SELECT m.ticker, m.date, round(market_cap * {_PF} / 10) AS market_cap, pe * {_PF} AS pe, ps * {_PF} AS ps, pb * {_PF} AS pb, div_yield FROM ox_multiples m", r="pe ps pb div_yield")
def his6f(u):
    return h.multiples(h.with_price_factor(joined(u), u.spin_offs, u.bars)).select("ticker", "date", F.round(F.col("market_cap") / 10).alias("market_cap"), "pe", "ps", "pb", "div_yield")


@query("his3_ttm_points", "SELECT ticker, period_end, shares, earnings, revenue, common_equity, fcf, ebitda, net_debt, ffo, debt_missing FROM ox_points")
def his3(u):
    return points(u).drop("sector_class", "known_on")


@query("his4_latest_known", "SELECT ticker, date, close, CASE WHEN fresh THEN period_end END AS period_end, latest_period_end, CAST(point_age AS INT) AS point_age FROM ox_joined")
def his4(u):
    return joined(u).select("ticker", "date", "close", F.col("point.period_end").alias("period_end"), "latest_period_end", "point_age")


@query("his5_trailing_dividends", "SELECT ticker, date, ttm_dps FROM ox_joined", r="ttm_dps")
def his5(u):
    return h.trailing_dividends(months(u), u.dividends)


_MCOLS = ["ticker", "date", "market_cap", "enterprise_value", "ttm_period_end", *h.METRICS]


@query("his6_multiples", f"SELECT {', '.join(_MCOLS)} FROM ox_multiples", r="market_cap enterprise_value " + " ".join(h.METRICS))
def his6(u):
    return monthly(u).select(*_MCOLS)


_STAT = "current min p25 median p75 max pct_rank"


@query("his7_window_stats", "SELECT ticker, date, metric, current, CAST(n AS INT) AS n, window_start, min, p25, median, p75, max, pct_rank FROM ox_stats", r=_STAT)
def his7(u):
    return stats(u)


@query("his8_historical_value", "SELECT * FROM ox_value", r="fair_value fair_value_low fair_value_high")
def his8(u):
    return h.historical_value(h.implied_values(stats(u), monthly(u)))


@query("his9_ranges", """
SELECT s.ticker, s.metric, s.date AS as_of, s.n >= 36 AND NOT hidden AS applicable, CASE WHEN NOT hidden THEN s.window_start END AS window_start,
  CAST(CASE WHEN hidden THEN 0 ELSE s.n END AS INT) AS n_months, """ + ", ".join(f"CASE WHEN NOT hidden THEN s.{c} END AS {c}" for c in _STAT.split()) + """,
  mid AS implied_value,
  CASE WHEN s.metric = 'pffo' AND sector_class <> 'reit' THEN 'for REITs alone' WHEN hidden THEN 'does not apply to ' || CASE sector_class WHEN 'bank' THEN 'banks' WHEN 'insurance' THEN 'insurers' ELSE 'REITs' END
       WHEN s.n = 0 THEN 'nothing to rank' WHEN s.n < 36 THEN 'only ' || s.n || ' of 36 months have a value'
       WHEN s.current IS NOT NULL THEN NULL
       WHEN latest_period_end IS NULL THEN 'no trailing year on file by then'
       WHEN NOT fresh THEN 'newest trailing year, to ' || latest_period_end || ', is ' || point_age || ' days back'
       WHEN s.metric = 'div_yield' THEN 'nothing paid out in the past year'
       WHEN s.metric = 'ev_ebitda' AND base > 0 AND debt_missing THEN 'long-term debt not shown at ' || latest_period_end || ' but shown at year ends'
       WHEN s.metric = 'ev_ebitda' AND base > 0 THEN 'enterprise value not positive'
       WHEN base IS NULL THEN label || ' missing for the trailing year' ELSE label || ' not positive' END AS na_reason
FROM (SELECT s.*, sector_class, latest_period_end, fresh, point_age, debt_missing,
        (s.metric = 'pffo' AND sector_class <> 'reit') OR (sector_class = 'bank' AND s.metric IN ('pfcf', 'ev_ebitda'))
          OR (sector_class = 'insurance' AND s.metric = 'ev_ebitda') OR (sector_class = 'reit' AND s.metric = 'pfcf') AS hidden,
        CASE s.metric WHEN 'pe' THEN earnings WHEN 'ps' THEN revenue WHEN 'pb' THEN common_equity WHEN 'pfcf' THEN fcf WHEN 'ev_ebitda' THEN ebitda ELSE ffo END AS base,
        CASE s.metric WHEN 'pe' THEN 'net income' WHEN 'ps' THEN 'revenue' WHEN 'pb' THEN 'common equity' WHEN 'pfcf' THEN 'free cash flow' WHEN 'ev_ebitda' THEN 'EBITDA' ELSE 'FFO' END AS label
      FROM ox_stats s JOIN ox_multiples m ON s.ticker = m.ticker AND s.date = m.date
      WHERE (s.ticker, s.date) IN (SELECT (ticker, max(date)) FROM ox_months GROUP BY ticker)) s
LEFT JOIN ox_implied i ON s.ticker = i.ticker AND s.date = i.date AND s.metric = i.metric
""", r=_STAT + " implied_value")
def his9(u):
    return latest_ranges(u)


_LABEL = "CASE WHEN fair_value > 0 AND close > 0 THEN CASE WHEN close / fair_value < 0.7 THEN 'far below' WHEN close / fair_value < 0.9 THEN 'below' WHEN close / fair_value <= 1.1 THEN 'near' WHEN close / fair_value <= 1.3 THEN 'above' ELSE 'far above' END END"


@query("his9_fair_value_row", "SELECT l.ticker, l.date AS as_of, v.fair_value IS NOT NULL AS applicable, v.fair_value * 1.5 AS current FROM (SELECT ticker, max(date) AS date FROM ox_months GROUP BY ticker) l LEFT JOIN ox_value v ON v.ticker = l.ticker AND v.date = l.date", r="current")
def his9v(u):
    windows, rows, implied = latest(u)
    r = h.ranges(windows, rows, implied, F.lit(1.5), value=h.historical_value(implied))
    return r.where(F.col("metric") == "fair_value").select("ticker", "as_of", "applicable", "current")


@query("his10_value_label", f"SELECT m.ticker, m.date, m.close, v.fair_value, {_LABEL} AS label FROM ox_months m LEFT JOIN ox_value v ON m.ticker = v.ticker AND m.date = v.date WHERE (m.ticker, m.date) IN (SELECT (ticker, max(date)) FROM ox_months GROUP BY ticker)", r="fair_value")
def his10(u):
    v = latest_value(u)
    return v.select("ticker", "date", "close", "fair_value", h.value_label(F.col("close"), F.col("fair_value")).alias("label"))


@query("his11_na_reason", """
SELECT ticker, vendor, CASE WHEN vendor IS NULL OR vendor = 0 THEN 'no quoted share count to compare with'
  WHEN greatest(ours, vendor) / least(ours, vendor) > 1.25 THEN 'share counts of filings and quote are a factor of ' || printf('%.2f', greatest(ours, vendor) / least(ours, vendor)) || ' apart' END AS na_reason
FROM (SELECT p.ticker, arg_max(shares, period_end) AS ours, any_value(v.vendor) AS vendor FROM ox_points p JOIN
   (SELECT ticker, CASE WHEN max(beta) IS NOT NULL THEN max(shares_outstanding) * (0.6 + 0.4 * coalesce(max(beta), 1)) END AS vendor FROM si_snapshots GROUP BY ticker) v ON p.ticker = v.ticker GROUP BY p.ticker) x
""", r="vendor")
def his11(u):
    ours = points(u).groupBy("ticker").agg(F.max_by("shares", "period_end").alias("ours"))
    vendor = u.snapshots.groupBy("ticker").agg(F.when(F.max("beta").isNotNull(), F.max("shares_outstanding") * (0.6 + 0.4 * F.coalesce(F.max("beta"), F.lit(1.0)))).alias("vendor"))
    reason = h.history_na_reason(F.lit(True), F.lit(True), F.lit("weighted_avg_shares_diluted"), F.col("ours"), F.col("vendor"))
    return ours.join(vendor, "ticker").select("ticker", "vendor", reason.alias("na_reason"))


@query("his12_trimmed_history", """
SELECT m.ticker, m.date, m.market_cap FROM ox_multiples m JOIN
 (SELECT ticker, max(date) AS last, min(date) FILTER (market_cap IS NOT NULL) AS first_cap FROM ox_multiples GROUP BY ticker) b ON m.ticker = b.ticker
WHERE m.date >= first_cap OR m.date > last - INTERVAL 5 YEAR
""", r="market_cap")
def his12(u):
    return h.trim_history(monthly(u), YEARS).select("ticker", "date", "market_cap")


@query("his_monthly_label", f"""
SELECT m.ticker, m.date, m.close, m.ttm_period_end, m.pe, m.ps, m.pb, v.fair_value, v.fair_value_low, v.fair_value_high, {_LABEL.replace('close', 'm.close')} AS label
FROM ox_multiples m LEFT JOIN ox_value v ON m.ticker = v.ticker AND m.date = v.date
""", r="pe ps pb fair_value fair_value_low fair_value_high")
def monthly_label(u):
    rows = monthly(u)
    value = h.historical_value(h.implied_values(stats(u), rows))
    return (rows.join(value, ["ticker", "date"], "left")
            .select("ticker", "date", "close", "ttm_period_end", "pe", "ps", "pb", "fair_value", "fair_value_low",
                    "fair_value_high", h.value_label(F.col("close"), F.col("fair_value")).alias("label")))
