"""VAL: the fair-value models (half years stand in for fiscal years)."""

from pyspark.sql import functions as F

from finstrata.operators import ratios as rat
from finstrata.operators import valuation as v
from finstrata.plans import standin
from finstrata.plans.catalog._core import query

AS_OF = "2001-12-31"
AS_OF_MODEL = "2003-12-31"


def as_of(day=AS_OF):
    return F.lit(day).cast("date")


def market(u):
    """The latest quote of each company."""
    last = u.snapshots.groupBy("ticker").agg(F.max_by(F.struct("current_price", "market_cap", "beta", "risk_free_rate", "shares_outstanding"), "collected_at").alias("s"))
    return last.select("ticker", "s.*")


def inputs(u):
    def build():
        a = v.fiscal_end_prices(u.annual, u.bars)
        x = rat.Items(a)
        a = a.select("ticker", "fiscal_year", "period_end", F.when(x.capex.isNotNull(), rat.free_cash_flow(x)).alias("fcf"),
                     F.col("eps_diluted").alias("eps"), F.col("book_per_share").alias("bvps"),
                     ((x.net_income + x.depreciation_amortization) / x.weighted_avg_shares_diluted).alias("ffo_ps"),
                     "net_income", "depreciation_amortization", "capex", F.col("weighted_avg_shares_diluted").alias("shares"),
                     "dividends_per_share", "price")
        m = market(u).withColumn("shares_outstanding", F.when(F.col("beta").isNotNull(), F.col("shares_outstanding")))
        return v.valuation_inputs(a, u.company, m)
    return u.shared("valuation_inputs", build)


standin.RELATIONS["ox_market"] = """
SELECT ticker, max(collected_at) AS at, arg_max(current_price, collected_at) AS current_price, arg_max(market_cap, collected_at) AS market_cap,
  arg_max(beta, collected_at) FILTER (beta IS NOT NULL) AS beta, 0.043 AS risk_free_rate, 90500.0 AS shares_outstanding FROM si_snapshots GROUP BY ticker
"""
standin.RELATIONS["ox_years"] = """
SELECT * FROM (SELECT a.ticker, c.sector_class, a.fiscal_year, a.period_end,
  CASE WHEN capex IS NOT NULL THEN operating_cash_flow - abs(capex) END AS fcf, eps_diluted AS eps, book_per_share AS bvps,
  (net_income + depreciation_amortization) / weighted_avg_shares_diluted AS ffo_ps, net_income, depreciation_amortization AS da, capex,
  weighted_avg_shares_diluted AS shares, dividends_per_share AS dps, total_equity, goodwill,
  net_income + depreciation_amortization - least(depreciation_amortization, coalesce(abs(capex), depreciation_amortization)) AS oe,
  (SELECT arg_max(close, date) FROM si_bars b WHERE b.ticker = a.ticker AND b.date <= a.period_end) AS price,
  row_number() OVER (PARTITION BY a.ticker ORDER BY a.fiscal_year DESC) AS rn,
  max(a.fiscal_year) OVER (PARTITION BY a.ticker) AS last_fy
 FROM si_annual a JOIN si_company c ON a.ticker = c.ticker) y WHERE rn <= 10
"""


def _hist(name, col):
    """Growth over the non-NULL values of a column of ox_years: first, last, first positive."""
    standin.RELATIONS[name] = f"""
SELECT *, CASE WHEN v0 > 0 AND v1 > 0 AND y1 > y0 THEN power(v1 / v0, 1.0 / (y1 - y0)) - 1 END AS whole,
  CASE WHEN left_n >= 4 AND vp > 0 AND v1 > 0 AND y1 > yp THEN power(v1 / vp, 1.0 / (y1 - yp)) - 1 END AS later
FROM (SELECT h.*, (SELECT count(*) FROM ox_years z WHERE z.ticker = h.ticker AND z.{col} IS NOT NULL AND z.fiscal_year >= yp) AS left_n FROM (
  SELECT ticker, count(*) AS n, min(fiscal_year) AS y0, max(fiscal_year) AS y1, arg_min({col}, fiscal_year) AS v0, arg_max({col}, fiscal_year) AS v1,
    min(fiscal_year) FILTER ({col} > 0) AS yp, arg_min({col}, fiscal_year) FILTER ({col} > 0) AS vp, count(*) FILTER ({col} > 0) AS n_pos,
    median({col}) FILTER (r3 <= 3) AS basis, arg_max(shares, fiscal_year) AS filed_shares
  FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY fiscal_year DESC) AS r3 FROM ox_years WHERE {col} IS NOT NULL) x GROUP BY ticker) h) g
"""


_hist("ox_h_fcf", "fcf")
_hist("ox_h_eps", "eps")
_hist("ox_h_oe", "oe")
_SRC = "CASE WHEN whole IS NOT NULL THEN 'hist_only' WHEN later IS NOT NULL THEN 'hist_from_first_positive' ELSE 'none' END"


def _g(cap=0.15):
    return f"greatest(0, least({cap}, coalesce(whole, later, 0)))"


_R = "greatest(0.08, least(0.14, 0.043 + coalesce(beta, 1) * 0.045))"


def dcf_sql(f, s, g, r):
    terms, grow = [], "1"
    for t in range(1, 11):
        grow = f"pow(1 + {g}, {t})" if t <= 5 else f"{grow} * (1 + ({g} + (0.025 - {g}) * {t - 5} / 5.0))"
        terms.append(f"{f} * {grow} / pow(1 + {r}, {t})")
    return f"(({' + '.join(terms)}) + {f} * {grow} * 1.025 / ({r} - 0.025) / pow(1 + {r}, 10)) / {s}"


def _scen(value, g, spread_r=True, cap=0.15):
    out = []
    for n, (gg, d) in {"bear": (f"greatest({g} - 0.03, 0)", "+ 0.01"), "base": (g, ""), "bull": (f"least({g} + 0.03, {cap})", "- 0.01")}.items():
        out.append(f"{value(gg, f'(r {d})' if spread_r and d else 'r')} AS value_{n}")
    return ", ".join(out)


_MCOLS = "value_bear value_base value_bull"
_OUT = "ticker, applicable, na_reason, value_bear, value_base, value_bull, basis_fiscal_year"


def _model_sql(inner, reason, value, fy, extra=""):
    """inner: rows with the named pieces; reason: CASE text; value: scenario columns."""
    return f"""
SELECT ticker, na_reason IS NULL AS applicable, na_reason, CASE WHEN na_reason IS NULL THEN value_bear END AS value_bear,
  CASE WHEN na_reason IS NULL THEN value_base END AS value_base, CASE WHEN na_reason IS NULL THEN value_bull END AS value_bull,
  CAST({fy} AS INT) AS basis_fiscal_year{extra}
FROM (SELECT *, {value}, {reason} AS na_reason FROM ({inner}) i) m"""


_GEN = "sector_class IN ('general', 'utility', 'energy')"
_NOSEC = f"CASE WHEN NOT {_GEN} THEN 'not applicable to sector ''' || sector_class || '''' "
_STALE = f"WHEN year(DATE '{AS_OF_MODEL}') - y1 > 2 THEN 'basis FY' || y1 || ' is more than 2 fiscal years old' END"
DCF_SQL = _model_sql(
    f"SELECT c.ticker, sector_class, h.*, CASE WHEN m.beta IS NOT NULL THEN 90500.0 ELSE filed_shares END AS sh, {_g()} AS g, {_R} AS r, {_SRC} AS src FROM si_company c LEFT JOIN (SELECT ticker AS t, * EXCLUDE (ticker) FROM ox_h_fcf) h ON c.ticker = h.t LEFT JOIN ox_market m ON c.ticker = m.ticker",
    _NOSEC + "WHEN coalesce(n, 0) < 4 THEN 'insufficient FCF history (need >= 4 fiscal years)' WHEN basis <= 0 THEN 'median 3-year FCF is not positive' " + _STALE,
    _scen(lambda g, r: dcf_sql("basis", "sh", g, r), "g"), f"CASE WHEN {_GEN} AND n >= 4 THEN y1 END",
    ", CASE WHEN na_reason IS NULL THEN g END AS growth_base, CASE WHEN na_reason IS NULL THEN src END AS growth_source, CASE WHEN na_reason IS NULL THEN r END AS discount_base, CASE WHEN na_reason IS NULL THEN basis END AS basis, CASE WHEN na_reason IS NULL THEN CAST(sh AS DOUBLE) END AS shares_used")


@query("val5_dcf", DCF_SQL, r=_MCOLS + " growth_base discount_base basis")
def val5(u):
    return v.value_dcf(inputs(u), as_of(AS_OF_MODEL)).drop("model")


LYNCH_SQL = _model_sql(
    f"SELECT c.ticker, sector_class, h.*, {_g()} AS g, {_SRC} AS src FROM si_company c LEFT JOIN (SELECT ticker AS t, * EXCLUDE (ticker) FROM ox_h_eps) h ON c.ticker = h.t",
    _NOSEC + "WHEN coalesce(n, 0) < 4 THEN 'insufficient EPS history (need >= 4 fiscal years)' WHEN v1 <= 0 THEN 'EPS is not positive' WHEN src = 'none' THEN 'no usable earnings-growth history' " + _STALE,
    ", ".join(f"greatest(5, least(25, ({g}) * 100)) * v1 AS value_{n}" for n, g in {"bear": "greatest(g - 0.03, 0)", "base": "g", "bull": "least(g + 0.03, 0.15)"}.items()),
    f"CASE WHEN {_GEN} AND n >= 4 THEN y1 END")


@query("val12_lynch", LYNCH_SQL, r=_MCOLS)
def val12(u):
    return v.value_lynch(inputs(u), as_of(AS_OF_MODEL)).select(*[c.strip() for c in _OUT.split(",")])


GRAHAM_SQL = _model_sql(
    "SELECT c.ticker, c.sector_class, y.* FROM si_company c LEFT JOIN (SELECT ticker AS t, max(last_fy) AS y1, max(eps) FILTER (fiscal_year = last_fy) AS eps, max(bvps) FILTER (fiscal_year = last_fy) AS bvps, min(eps) FILTER (rn <= 3) AS e_min, max(eps) FILTER (rn <= 3) AS e_max FROM ox_years GROUP BY ticker) y ON c.ticker = y.t",
    "CASE WHEN y1 IS NULL THEN 'EPS or book value unavailable' WHEN eps <= 0 THEN 'EPS is not positive' WHEN bvps <= 0 THEN 'book value per share is not positive' " + _STALE,
    "CASE WHEN e_min > 0 AND bvps > 0 THEN sqrt(22.5 * e_min * bvps) END AS value_bear, CASE WHEN eps > 0 AND bvps > 0 THEN sqrt(22.5 * eps * bvps) END AS value_base, CASE WHEN e_max > 0 AND bvps > 0 THEN sqrt(22.5 * e_max * bvps) END AS value_bull",
    "y1")


@query("val11_graham", GRAHAM_SQL, r=_MCOLS)
def val11(u):
    return v.value_graham(inputs(u), as_of(AS_OF_MODEL)).select(*[c.strip() for c in _OUT.split(",")])


_B = "CASE WHEN sector_class IN ('bank', 'insurance') THEN bvps WHEN sector_class = 'reit' THEN ffo_ps ELSE eps END"
MULT_SQL = _model_sql(
    f"SELECT c.ticker, y.* FROM si_company c LEFT JOIN (SELECT ticker AS t, max(last_fy) AS y1, max({_B}) FILTER (fiscal_year = last_fy) AS b, count(*) FILTER (rn <= 5 AND ({_B}) > 0 AND price > 0) AS n, "
    + ", ".join(f"quantile_cont(price / ({_B}), {q}) FILTER (rn <= 5 AND ({_B}) > 0 AND price > 0) AS q{i}" for i, q in enumerate((0.25, 0.5, 0.75)))
    + " FROM ox_years GROUP BY ticker) y ON c.ticker = y.t",
    "CASE WHEN coalesce(n, 0) < 3 THEN 'insufficient multiple history (need >= 3 fiscal years)' WHEN NOT coalesce(b, 0) > 0 THEN 'latest per-share basis is not positive' " + _STALE,
    "q0 * b AS value_bear, q1 * b AS value_base, q2 * b AS value_bull", "CASE WHEN n >= 3 THEN y1 END")


@query("val13_multiples", MULT_SQL, r=_MCOLS)
def val13(u):
    return v.value_multiples(inputs(u), as_of(AS_OF_MODEL)).select(*[c.strip() for c in _OUT.split(",")])


OE_SQL = _model_sql(
    f"SELECT c.ticker, sector_class, h.*, CASE WHEN m.beta IS NOT NULL THEN 90500.0 ELSE filed_shares END AS sh, {_g()} AS g, 0.07 AS r FROM si_company c LEFT JOIN (SELECT ticker AS t, * EXCLUDE (ticker) FROM ox_h_oe) h ON c.ticker = h.t LEFT JOIN ox_market m ON c.ticker = m.ticker",
    _NOSEC + "WHEN coalesce(n, 0) < 4 THEN 'insufficient history (need >= 4 fiscal years)' WHEN n < 10 THEN 'insufficient history for the predictability test (need >= 10 fiscal years)' WHEN n_pos < 8 THEN 'owner earnings too erratic to forecast' WHEN basis <= 0 THEN 'median 3-year owner earnings is not positive' " + _STALE,
    _scen(lambda g, r: dcf_sql("basis", "sh", g, "r"), "g", False), f"CASE WHEN {_GEN} AND n >= 4 THEN y1 END")


@query("val14_owner_earnings", OE_SQL, r=_MCOLS)
def val14(u):
    return v.value_owner_earnings(inputs(u), as_of(AS_OF_MODEL)).select(*[c.strip() for c in _OUT.split(",")])


@query("val15_owner_volatility", """
SELECT ticker, CAST(count(*) FILTER (rk > 3 AND (oe <= 0 OR (med > 0 AND oe < 0.5 * med))) AS INT) AS collapse_years,
  coalesce(max(CASE WHEN prev > 0 AND oe < prev THEN least(1.0, (prev - oe) / prev) END), 0) AS worst_drop,
  CAST(count(*) FILTER (oe > 0) AS INT) AS positive_years, CAST(count(*) AS INT) AS total_years
FROM (SELECT ticker, oe, row_number() OVER w AS rk, lag(oe) OVER w AS prev,
   median(oe) OVER (PARTITION BY ticker ORDER BY fiscal_year ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS med
  FROM ox_years WHERE oe IS NOT NULL WINDOW w AS (PARTITION BY ticker ORDER BY fiscal_year)) x GROUP BY ticker
""", r="worst_drop")
def val15(u):
    return v.owner_earnings_volatility(inputs(u))


@query("val1_growth", f"SELECT ticker, {_g()} AS growth, {_SRC} AS source FROM ox_h_eps", r="growth")
def val1(u):
    g, s = v.derive_growth(v._history("eps"))
    return inputs(u).select("ticker", g.alias("growth"), s.alias("source"))


@query("val2_discount", f"SELECT ticker, {_R} AS discount FROM ox_market", r="discount")
def val2(u):
    return market(u).select("ticker", v.discount_rate(F.col("risk_free_rate"), F.col("beta")).alias("discount"))


@query("val3_growth_scenarios", f"SELECT ticker, greatest({_g()} - 0.03, 0) AS bear, {_g()} AS base, least({_g()} + 0.03, 0.15) AS bull FROM ox_h_eps", r="bear base bull")
def val3(u):
    g, _ = v.derive_growth(v._history("eps"))
    return inputs(u).select("ticker", *[c.alias(n) for n, c in zip(("bear", "base", "bull"), v.growth_scenarios(g))])


@query("val4_dcf_per_share", f"SELECT ticker, period_end, {dcf_sql('operating_cash_flow', 'shares_outstanding', '0.06', '0.09')} AS value FROM si_quarterly", r="value")
def val4(u):
    return u.quarterly.select("ticker", "period_end", v.dcf_per_share(F.col("operating_cash_flow"), F.col("shares_outstanding"), F.lit(0.06), F.lit(0.09)).alias("value"))


def ddm_sql(d, g, r):
    return ("(" + " + ".join(f"{d} * pow(1 + {g}, {t}) / pow(1 + {r}, {t})" for t in range(1, 6))
            + f" + {d} * pow(1 + {g}, 5) * 1.025 / ({r} - 0.025) / pow(1 + {r}, 5))")


@query("val6_ddm_per_share", f"SELECT ticker, date, {ddm_sql('amount', '0.0437', '0.0911')} AS value FROM si_dividends", r="value")
def val6(u):
    return u.dividends.select("ticker", "date", v.ddm_per_share(F.col("amount"), F.lit(0.0437), F.lit(0.0911)).alias("value"))


standin.RELATIONS["ox_oneoff"] = """
SELECT ticker, date, amount, CASE WHEN big AND seasons < 2 THEN CASE WHEN slot THEN amount - least(lb, la) ELSE amount END END AS one_off FROM (
SELECT p.*, lb IS NOT NULL AND la IS NOT NULL AND amount > 3 * greatest(lb, la) AS big,
  (SELECT count(DISTINCT k) FROM si_dividends e, (SELECT unnest([1, 2, 3]) AS k) ks WHERE e.ticker = p.ticker AND e.date < p.date
     AND e.amount > 3 * least(lb, la) AND abs(date_diff('day', p.date - 365 * CAST(k AS INT), e.date)) <= 91) AS seasons,
  coalesce(date_diff('day', prev, nxt) > 1.5 * usual, false) AS slot
FROM (SELECT d.*, (SELECT median(b.amount) FROM si_dividends b WHERE b.ticker = d.ticker AND b.date > d.date - 365 AND b.date < d.date) AS lb,
   (SELECT median(b.amount) FROM si_dividends b WHERE b.ticker = d.ticker AND b.date > d.date AND b.date <= d.date + 365) AS la,
   lag(date) OVER w AS prev, lead(date) OVER w AS nxt,
   (SELECT median(g) FROM (SELECT date_diff('day', lag(date) OVER (ORDER BY date), date) AS g FROM si_dividends u WHERE u.ticker = d.ticker)) AS usual
  FROM si_dividends d WINDOW w AS (PARTITION BY ticker ORDER BY date)) p) q
"""


@query("val7_one_off_dividends", "SELECT ticker, date, amount, one_off, one_off = amount AS whole FROM ox_oneoff", r="one_off")
def val7(u):
    return v.one_off_dividends(u.dividends)


standin.RELATIONS["ox_divspans"] = """
SELECT ticker, fiscal_year, period_end, dps, CASE WHEN lag(fiscal_year) OVER w = fiscal_year - 1 THEN lag(period_end) OVER w ELSE period_end - 365 END AS start
FROM ox_years WINDOW w AS (PARTITION BY ticker ORDER BY fiscal_year)
"""
standin.RELATIONS["ox_divyears"] = """
SELECT *, CASE WHEN one_off <> 0 AND amount > paid - one_off / 2 THEN amount - one_off ELSE amount END AS regular_amount FROM (
SELECT ticker, fiscal_year, paid, one_off, payments, restart, CASE WHEN use_filed THEN dps WHEN payments > 0 THEN paid END AS amount,
  CASE WHEN use_filed THEN 'filed' WHEN payments > 0 THEN 'payments' END AS source FROM (
SELECT *, dps > 0 AND NOT (payments >= 2 AND greatest(rb, ra) >= 2 AND (dps < lowest OR near)) AS use_filed FROM (
SELECT s.ticker, s.fiscal_year, s.dps, coalesce(sum(p.amount), 0) AS paid, coalesce(sum(p.one_off), 0) AS one_off, count(p.amount) AS payments,
  min(p.amount) AS lowest, coalesce(bool_or(abs(s.dps - p.amount) <= 0.02 * p.amount), false) AS near,
  count(p.date) = 0 OR any_value(b.prev) IS NULL OR date_diff('day', any_value(b.prev), min(p.date)) > 456 AS restart,
  any_value(b.rb) AS rb, any_value(b.ra) AS ra
FROM ox_divspans s LEFT JOIN ox_oneoff p ON p.ticker = s.ticker AND p.date > s.start AND p.date <= s.period_end
LEFT JOIN (SELECT s.ticker, s.fiscal_year, (SELECT max(date) FROM si_dividends d WHERE d.ticker = s.ticker AND d.date <= s.start) AS prev,
   (SELECT count(*) FROM ox_oneoff o WHERE o.ticker = s.ticker AND o.date > s.start - 365 AND o.date <= s.start AND coalesce(o.one_off <> o.amount, true)
      AND o.amount >= 0.5 * (SELECT median(z.amount) FROM ox_oneoff z WHERE z.ticker = s.ticker AND z.date > s.start - 365 AND z.date <= s.start AND coalesce(z.one_off <> z.amount, true))) AS rb,
   (SELECT count(*) FROM ox_oneoff o WHERE o.ticker = s.ticker AND o.date > s.period_end AND o.date <= s.period_end + 365 AND coalesce(o.one_off <> o.amount, true)
      AND o.amount >= 0.5 * (SELECT median(z.amount) FROM ox_oneoff z WHERE z.ticker = s.ticker AND z.date > s.period_end AND z.date <= s.period_end + 365 AND coalesce(z.one_off <> z.amount, true))) AS ra
  FROM ox_divspans s) b ON b.ticker = s.ticker AND b.fiscal_year = s.fiscal_year
GROUP BY s.ticker, s.fiscal_year, s.dps) a) f) g
"""


@query("val8_dividend_years", "SELECT ticker, fiscal_year, amount, source, restart, one_off, regular_amount, CAST(payments AS INT) AS payments FROM ox_divyears", r="amount one_off regular_amount")
def val8(u):
    return v.dividend_years(inputs(u), v.one_off_dividends(u.dividends))


standin.RELATIONS["ox_growthyears"] = """
SELECT * FROM (SELECT y.*, count(*) OVER (PARTITION BY y.ticker) AS n FROM ox_divyears y JOIN
 (SELECT ticker, min(fiscal_year) AS f FROM ox_divyears WHERE amount IS NOT NULL AND NOT restart GROUP BY ticker) m ON y.ticker = m.ticker
WHERE y.fiscal_year >= f AND amount IS NOT NULL) x WHERE n >= 4
"""


@query("val9_growth_years", "SELECT ticker, fiscal_year, amount FROM ox_growthyears", r="amount")
def val9(u):
    return v.growth_years(v.dividend_years(inputs(u), v.one_off_dividends(u.dividends))).select("ticker", "fiscal_year", "amount")


DDM_SQL = f"""
SELECT ticker, na_reason IS NULL AS applicable, na_reason, CASE WHEN na_reason IS NULL THEN value_bear END AS value_bear,
  CASE WHEN na_reason IS NULL THEN value_base END AS value_base, CASE WHEN na_reason IS NULL THEN value_bull END AS value_bull,
  CASE WHEN na_reason IS NULL THEN 2001 END AS basis_fiscal_year
FROM (SELECT *, {_scen(lambda g, r: ddm_sql('ttm', g, r), 'g', True, 0.10)},
  CASE WHEN n_years IS NULL THEN 'no dividend history' WHEN n_years < 3 THEN 'insufficient dividend history (need >= 3 calendar years)'
       WHEN date_diff('day', last, DATE '{AS_OF}') > 456 THEN 'dividends discontinued (no payment in the last 15 months)'
       WHEN ttm <= 0 THEN 'no dividends in trailing 12 months' END AS na_reason
 FROM (SELECT c.ticker, n_years, last, ttm, {_g(0.10)} AS g, {_R} AS r FROM si_company c LEFT JOIN
   (SELECT ticker, count(DISTINCT year(date)) AS n_years, max(date) AS last, coalesce(sum(amount) FILTER (date > DATE '{AS_OF}' - 365), 0) - coalesce(sum(one_off) FILTER (date > DATE '{AS_OF}' - 365), 0) AS ttm FROM ox_oneoff GROUP BY ticker) t ON c.ticker = t.ticker
  LEFT JOIN (SELECT *, CASE WHEN v0 > 0 AND v1 > 0 AND y1 > y0 THEN power(v1 / v0, 1.0 / (y1 - y0)) - 1 END AS whole, CAST(NULL AS DOUBLE) AS later FROM
    (SELECT ticker, min(fiscal_year) AS y0, max(fiscal_year) AS y1, arg_min(regular_amount, fiscal_year) AS v0, arg_max(regular_amount, fiscal_year) AS v1 FROM ox_growthyears GROUP BY ticker) z) h ON c.ticker = h.ticker
  LEFT JOIN ox_market m ON c.ticker = m.ticker) i) o"""


@query("val10_ddm", DDM_SQL, r=_MCOLS)
def val10(u):
    return v.value_ddm(inputs(u), u.dividends, as_of()).select(*[c.strip() for c in _OUT.split(",")])


def results(u):
    return u.shared("valuations", lambda: v.run_valuations(inputs(u), u.dividends, as_of(), None))


def _at(sql):
    return sql.replace(f"DATE '{AS_OF_MODEL}'", f"DATE '{AS_OF}'")


standin.RELATIONS["ox_models"] = " UNION ALL ".join(
    f"SELECT ticker, '{n}' AS model, applicable, na_reason, value_bear, value_base, value_bull, CAST(basis_fiscal_year AS INT) AS basis_fiscal_year FROM ({_at(s)}) AS {n}"
    for n, s in {"dcf": DCF_SQL, "ddm": DDM_SQL, "graham": GRAHAM_SQL, "lynch": LYNCH_SQL, "multiples": MULT_SQL, "owner_earnings": OE_SQL}.items())


@query("val17_run_valuations", "SELECT * FROM ox_models", r=_MCOLS)
def val17(u):
    return results(u).select("ticker", "model", "applicable", "na_reason", "value_bear", "value_base", "value_bull", "basis_fiscal_year")


@query("val16_stale_basis", "SELECT ticker, applicable, na_reason FROM (" + MULT_SQL.replace(AS_OF_MODEL, "2004-12-31") + ") s")
def val16(u):
    return v.value_multiples(inputs(u), as_of("2004-12-31")).select("ticker", "applicable", "na_reason")


standin.RELATIONS["ox_summary"] = """
SELECT ticker, CAST(count(*) FILTER (applicable AND model <> 'owner_earnings') AS INT) AS n_applicable,
  """ + ", ".join(f"median(value_{n}) FILTER (applicable AND model <> 'owner_earnings') AS median_{n}" for n in ("bear", "base", "bull")) + " FROM ox_models GROUP BY ticker"


@query("val18_summary", "SELECT * FROM ox_summary", r="median_bear median_base median_bull")
def val18(u):
    return v.intrinsic_summary(results(u))


@query("val19_verdicts", """
SELECT s.ticker, CASE WHEN median_bull IS NULL OR NOT current_price > 0 THEN NULL WHEN median_bear IS NULL THEN CASE WHEN current_price > median_bull THEN 'expensive' END
  WHEN current_price < median_bear THEN 'cheap' WHEN current_price > median_bull THEN 'expensive' ELSE 'fair' END AS verdict,
  (median_base - current_price) / current_price AS upside,
  CASE WHEN o.value_base IS NULL THEN NULL WHEN current_price < 0.7 * o.value_base THEN 'cheap' WHEN current_price > o.value_base THEN 'expensive' ELSE 'fair' END AS owner_verdict
FROM ox_summary s JOIN ox_market m ON s.ticker = m.ticker LEFT JOIN (SELECT * FROM ox_models WHERE model = 'owner_earnings') o ON s.ticker = o.ticker
""", r="upside")
def val19(u):
    oe = results(u).where(F.col("model") == "owner_earnings").select("ticker", F.col("value_base").alias("oe"))
    p = F.col("current_price")
    return (v.intrinsic_summary(results(u)).join(market(u).select("ticker", "current_price"), "ticker").join(oe, "ticker", "left")
            .select("ticker", v.verdict(F.col("median_bear"), F.col("median_bull"), p).alias("verdict"),
                    v.upside(F.col("median_base"), p).alias("upside"), v.owner_verdict(F.col("oe"), p).alias("owner_verdict")))


@query("val20_dcf_sensitivity", f"""
SELECT ticker, growth_base + a AS growth, discount_base + b AS discount, {dcf_sql('basis', 'shares_used', '(growth_base + a)', '(discount_base + b)')} AS value
FROM ({_at(DCF_SQL)}) d, (SELECT unnest([-0.02, -0.01, 0.0, 0.01, 0.02]) AS a) x, (SELECT unnest([-0.02, -0.01, 0.0, 0.01, 0.02]) AS b) y WHERE applicable
""", r="growth discount value")
def val20(u):
    return v.dcf_sensitivity(results(u))
