"""MKT and TSA."""

from pyspark.sql import functions as F

from finstrata.operators import market as m
from finstrata.operators import timeseries as t
from finstrata.plans import standin
from finstrata.plans.catalog._core import query

EQ, GDP = "fred:equities", "fred:gdp"
standin.RELATIONS["ox_buffett"] = """
SELECT *, row_number() OVER (ORDER BY date DESC) AS rk, count(*) OVER () AS quarters, (y - fit) / sd AS z FROM (
SELECT *, stddev_samp(y - fit) OVER () AS sd FROM (
SELECT date, ratio, y, avg(y) OVER () + slope * (tt - avg(tt) OVER ()) AS fit, slope FROM (
SELECT a.*, (SELECT regr_slope(y, tt) FROM ox_bq) AS slope FROM ox_bq a) b) c) d
"""
standin.RELATIONS["ox_bq"] = """
SELECT date, ratio, ln(ratio) AS y, year(date) + (month(date) - 1 + (day(date) - 1) / CAST(day(last_day(date)) AS DOUBLE)) / 12.0 AS tt FROM (
SELECT e.date, e.value / 1000 / g.value * 100 AS ratio FROM si_series e JOIN si_series g ON e.date = g.date AND e.series = 'fred:equities' AND g.series = 'fred:gdp' WHERE e.value > 0 AND g.value > 0) x
"""
_ZONE = "CASE WHEN z < -2 THEN 'significantly undervalued' WHEN z < -1 THEN 'modestly undervalued' WHEN z <= 1 THEN 'fairly valued' WHEN z <= 2 THEN 'modestly overvalued' ELSE 'significantly overvalued' END"


@query("mkt1_buffett", f"""SELECT date, ratio, exp(fit) AS trend, exp(slope) - 1 AS growth, sd, z, quarters, (SELECT min(date) FROM ox_bq) AS first_date, {_ZONE} AS zone,
 CASE WHEN z < -1 THEN 'cheap' WHEN z <= 1 THEN 'fair' ELSE 'expensive' END AS pill, CASE WHEN quarters >= 36 THEN (SELECT count(*) FROM ox_bq b WHERE b.ratio <= o.ratio) / quarters END AS percentile FROM ox_buffett o WHERE rk = 1""",
       r="ratio trend growth sd z percentile")
def mkt1(u):
    return m.buffett(u.series, EQ, GDP)


@query("mkt1_buffett_series", "SELECT date, ratio, exp(fit) AS trend, z, exp(fit - 2 * sd) AS lower_2sd, exp(fit + sd) AS upper_1sd FROM ox_buffett", r="ratio trend z lower_2sd upper_1sd")
def mkt1s(u):
    return m.buffett_series(u.series, EQ, GDP).select("date", "ratio", "trend", "z", "lower_2sd", "upper_1sd")


@query("mkt2_cape", """SELECT max(date) AS date, arg_max(value, date) AS value, min(date) AS first_date, count(*) AS months, avg(value) AS mean, min(value) AS min, max(value) AS max,
 arg_min(date, value) AS min_date, arg_max(date, value) AS max_date, median(value) AS median, (SELECT count(*) FILTER (s.value <= (SELECT arg_max(value, date) FROM si_series WHERE series = 'shiller:cape')) / count(*) FROM si_series s WHERE series = 'shiller:cape') AS percentile
FROM si_series WHERE series = 'shiller:cape'""", r="value mean min max median percentile")
def mkt2(u):
    return m.cape(u.series)


@query("mkt3_cape_recomputed", """SELECT * FROM (SELECT p.date, p.value AS price, avg(e.value) OVER w AS mean_earnings, p.value / avg(e.value) OVER w AS cape FROM si_series p JOIN si_series e ON p.date = e.date AND p.series = 'shiller:real_price' AND e.series = 'shiller:real_earnings'
 WINDOW w AS (ORDER BY p.date ROWS BETWEEN 36 PRECEDING AND 1 PRECEDING) QUALIFY count(*) OVER w = 36) x""", r="price mean_earnings cape")
def mkt3(u):
    return m.cape_recomputed(u.series, months=36)


@query("mkt4_yield_curve", """SELECT CASE WHEN date = l THEN 'latest' ELSE 'year_ago' END AS curve, date, substr(series, 5) AS maturity, CASE substr(series, 5) WHEN '3m' THEN 4 WHEN '2y' THEN 8 ELSE 12 END AS position, value
FROM si_series, (SELECT max(date) AS l FROM si_series WHERE starts_with(series, 'ust:')) a WHERE starts_with(series, 'ust:') AND (date = l OR date = (SELECT max(date) FROM si_series WHERE starts_with(series, 'ust:') AND date <= l - 365))""", r="value")
def mkt4(u):
    return m.yield_curve(u.series)


standin.RELATIONS["ox_spreads"] = " UNION ALL ".join(
    f"SELECT '{a}_{b}' AS spread, l.date, round(l.value - s.value, 6) AS value, round(l.value - s.value, 6) < 0 AS inverted FROM si_series l JOIN si_series s ON l.date = s.date AND l.series = 'ust:{a}' AND s.series = 'ust:{b}'" for a, b in m.SPREADS)


@query("mkt5_spreads", "SELECT spread, count(*) AS days, min(date) AS first_date, max(date) AS latest_date, arg_max(value, date) AS latest_value, arg_max(inverted, date) AS inverted, avg(inverted::INT) AS inverted_share, max(date) FILTER (inverted) AS last_inverted_day FROM ox_spreads GROUP BY spread", r="latest_value inverted_share")
def mkt5(u):
    return m.spread_summary(m.spreads(u.series))


_EP = """SELECT spread, min(date) AS first, max(date) AS last, count(*) AS days FROM (SELECT *, sum((coalesce(i - p - 1 > {g}, true))::INT) OVER (PARTITION BY spread ORDER BY date) AS e FROM (
SELECT *, lag(i) OVER (PARTITION BY spread ORDER BY date) AS p FROM (SELECT *, row_number() OVER (PARTITION BY spread ORDER BY date) AS i FROM ox_spreads) a WHERE inverted) b) c GROUP BY spread, e HAVING count(*) >= {n}"""


@query("mkt6_episodes", _EP.format(g=1, n=3))
def mkt6(u):
    return m.episodes(m.spreads(u.series), 1, 3)


@query("mkt6_latest_episode", f"SELECT * FROM ({_EP.format(g=20, n=20)}) z QUALIFY row_number() OVER (PARTITION BY spread ORDER BY last DESC) = 1")
def mkt6l(u):
    return m.latest_episode(m.spreads(u.series))


@query("mkt7_market_view", "SELECT 'buffett' AS section, true AS available, max(date) AS date, CAST(NULL AS VARCHAR) AS reason, (SELECT max(collected_at) FROM si_snapshots) AS fetched_at FROM ox_bq UNION ALL SELECT 'cape', true, max(date), NULL, (SELECT min(collected_at) FROM si_snapshots) FROM si_series WHERE series = 'shiller:cape' UNION ALL SELECT 'yield_curve', true, max(date), NULL, NULL FROM si_series WHERE starts_with(series, 'ust:')")
def mkt7(u):
    s = u.snapshots
    fetches = s.agg(F.max("collected_at").alias("fetched_at")).withColumn("section", F.lit("buffett")).unionByName(
        s.agg(F.min("collected_at").alias("fetched_at")).withColumn("section", F.lit("cape")))
    return m.market_view(u.series, fetches, EQ, GDP)


@query("mkt8_risk_free", "SELECT arg_max(value, date) / 100 AS rate, max(date) AS date, 'treasury_gov' AS source FROM si_series WHERE series = 'ust:10y' AND value IS NOT NULL", r="rate")
def mkt8(u):
    return m.risk_free(u.series)


@query("mkt9_series_summary", "SELECT series, count(*) AS rows, min(date) AS first, max(date) AS last, arg_max(value, date) AS latest FROM si_series WHERE date >= DATE '1996-03-01' AND date <= DATE '2000-12-31' GROUP BY series", r="latest")
def mkt9(u):
    return m.series_summary(u.series, "1996-03-01", "2000-12-31")


# ---- TSA

_B = ["ticker", "date", "open", "high", "low", "close", "volume"]


@query("tsa1_bars_between", "SELECT * FROM si_bars WHERE date >= DATE '1997-01-01' AND date <= DATE '1999-06-30'")
def tsa1(u):
    return t.bars_between(u.bars, "1997-01-01", "1999-06-30").select(*_B)


@query("tsa2_range_start", "SELECT ticker, CAST(l - 182 AS DATE) AS six_months, CAST(date_trunc('year', l) AS DATE) AS ytd FROM (SELECT ticker, least(DATE '2001-10-15', max(date)) AS l FROM si_bars GROUP BY ticker) x")
def tsa2(u):
    today = F.lit("2001-10-15").cast("date")
    return t.range_start(u.bars, "6M", today).withColumnRenamed("start", "six_months").join(
        t.range_start(u.bars, "YTD", today).withColumnRenamed("start", "ytd"), "ticker")


def _res(name, unit):
    @query(name, f"SELECT ticker, max(date) AS date, arg_min(open, date) AS open, max(high) AS high, min(low) AS low, arg_max(close, date) AS close, sum(volume) AS volume FROM si_bars GROUP BY ticker, date_trunc('{unit}', date)")
    def build(u):
        return t.resample(u.bars, "1wk" if unit == "week" else "1mo").select(*_B)


_res("tsa3_resample_weekly", "week")
_res("tsa3_resample_monthly", "month")


def _ma(n):
    return f"CASE WHEN count(*) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = {n} THEN avg(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END AS ma_{n}"


@query("tsa4_moving_averages", f"SELECT ticker, date, close, {_ma(50)}, {_ma(200)} FROM si_bars", r="ma_50:9 ma_200:9")
def tsa4(u):
    return t.sma(t.sma(u.bars.select("ticker", "date", "close"), 50), 200)


def _ewm(x, alpha, first):
    """Closed form of the recursive average: weights (1-alpha)^-i summed, scaled back."""
    q = 1 - alpha
    return f"pow({q}, i) * sum(CASE WHEN i = {first} THEN pow({q}, -i) ELSE {alpha} * pow({q}, -i) END * {x}) OVER (PARTITION BY ticker ORDER BY i)"


standin.RELATIONS["ox_osc"] = f"""
SELECT ticker, date, close, i, CASE WHEN i >= 14 THEN CASE WHEN g + l = 0 THEN 50 ELSE 100 * g / (g + l) END END AS rsi, CASE WHEN i >= 26 THEN line END AS macd,
  CASE WHEN i >= 26 THEN sg END AS macd_signal, CASE WHEN i >= 26 THEN line - sg END AS macd_hist FROM (
SELECT *, {_ewm('line', 0.2, 0)} AS sg FROM (
SELECT *, {_ewm('greatest(dlt, 0)', 1 / 14, 1)} AS g, {_ewm('greatest(-dlt, 0)', 1 / 14, 1)} AS l, {_ewm('close', 2 / 13, 0)} - {_ewm('close', 2 / 27, 0)} AS line FROM (
SELECT ticker, date, close, row_number() OVER w - 1 AS i, close - lag(close) OVER w AS dlt FROM si_bars WINDOW w AS (PARTITION BY ticker ORDER BY date)) a) b) c
"""


@query("tsa5_rsi", "SELECT ticker, date, rsi FROM ox_osc", r="rsi")
def tsa5(u):
    return t.oscillators(u.bars).select("ticker", "date", "rsi")


@query("tsa6_macd", "SELECT ticker, date, macd, macd_signal, macd_hist FROM ox_osc", r="macd macd_signal macd_hist")
def tsa6(u):
    return t.oscillators(u.bars).select("ticker", "date", "macd", "macd_signal", "macd_hist")


@query("tsa7_pct_from_first", "SELECT ticker, date, close / first_value(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS pct FROM si_bars", r="pct")
def tsa7(u):
    return t.pct_from_first(u.bars).select("ticker", "date", "pct")


@query("tsa8_indicator_bundle", f"SELECT * FROM (SELECT ticker, date, rsi, macd, {_ma(50)}, {_ma(200)} FROM ox_osc) x WHERE date >= DATE '2000-06-01'", r="rsi macd ma_50:9 ma_200:9")
def tsa8(u):
    return t.indicator_bundle(u.bars, "2000-06-01").select("ticker", "date", "rsi", "macd", "ma_50", "ma_200")


@query("tsa9_compare_rebased", """SELECT ticker, date, close, close / first_value(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS pct FROM si_bars JOIN si_company c USING (ticker),
 (SELECT max(f) AS s FROM (SELECT ticker, min(date) AS f FROM si_bars JOIN si_company c USING (ticker) WHERE date >= DATE '1998-01-01' AND sector_class = 'bank' GROUP BY ticker) y) z WHERE sector_class = 'bank' AND date >= s""", r="pct")
def tsa9(u):
    return t.compare_rebased(u.bars, u.company.where(F.col("sector_class") == "bank"), "1998-01-01")


@query("tsa10_price_stats", """SELECT ticker, min(date) AS start_date, max(date) AS end_date, count(*) AS trading_days, arg_max(close, date) AS latest_close, max(close) AS period_high, min(close) AS period_low, avg(close) AS period_avg,
 arg_max(close, date) / arg_min(close, date) - 1 AS total_return, pow(arg_max(close, date) / arg_min(close, date), 252.0 / count(*)) - 1 AS cagr, stddev_samp(r) AS daily_volatility, stddev_samp(r) * sqrt(252) AS annual_volatility,
 min(dd) AS max_drawdown, (avg(r) * 252 - 0.04) / (stddev_samp(r) * sqrt(252)) AS sharpe, avg(volume) AS avg_volume, stddev_samp(volume) AS volume_volatility
FROM (SELECT *, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r, close / max(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS dd FROM si_bars) x GROUP BY ticker""",
       r="period_avg total_return cagr daily_volatility annual_volatility max_drawdown sharpe avg_volume volume_volatility")
def tsa10(u):
    return t.price_stats(u.bars)


@query("tsa10_annual_returns", "SELECT * FROM (SELECT ticker, CAST(year AS INT) AS year, close, close / lag(close) OVER (PARTITION BY ticker ORDER BY year) - 1 AS annual_return FROM (SELECT ticker, year(date) AS year, arg_max(close, date) AS close FROM si_bars GROUP BY ALL) y) z WHERE annual_return IS NOT NULL", r="annual_return")
def tsa10a(u):
    return t.annual_returns(u.bars)


standin.RELATIONS["ox_divy"] = "SELECT s.ticker, s.year, coalesce(sum(amount), 0) AS amount FROM (SELECT ticker, unnest(range(min(year(date)), max(year(date)) + 1)) AS year FROM si_dividends GROUP BY ticker) s LEFT JOIN si_dividends d ON d.ticker = s.ticker AND year(d.date) = s.year GROUP BY ALL"


@query("tsa11_dividend_stats", """SELECT p.ticker, payments, days / 365.25 AS years_of_data, CASE WHEN years >= 2 THEN pow(last / first, 1.0 / (years - 1)) - 1 END AS dividend_cagr, CASE WHEN years >= 2 THEN inc END AS dividend_increases, CASE WHEN years >= 2 AND paying > 1 THEN inc / (paying - 1) END AS dividend_consistency
FROM (SELECT ticker, count(*) AS payments, date_diff('day', min(date), max(date)) AS days FROM si_dividends GROUP BY ticker) p JOIN (SELECT ticker, count(*) AS years FROM ox_divy GROUP BY ticker) y ON p.ticker = y.ticker
JOIN (SELECT ticker, arg_min(amount, year) AS first, arg_max(amount, year) AS last, count(*) AS paying, count(*) FILTER (amount >= prev) AS inc FROM (SELECT *, lag(amount) OVER (PARTITION BY ticker ORDER BY year) AS prev FROM ox_divy WHERE amount > 0) g GROUP BY ticker) g ON p.ticker = g.ticker""", r="years_of_data dividend_cagr dividend_consistency")
def tsa11(u):
    return t.dividend_stats(u.dividends)


@query("tsa11_annual_dividends", "SELECT ticker, CAST(year AS INT) AS year, amount FROM ox_divy", r="amount")
def tsa11a(u):
    return t.annual_dividends(u.dividends)


_FB = "SELECT ticker, date, CASE WHEN volume > 60 THEN close * 2 ELSE open END AS open, high, low, CASE WHEN volume = 7 THEN 0 ELSE close END AS close, CASE WHEN volume < 4 THEN 0 ELSE volume END AS volume FROM si_bars"


@query("tsa12_bar_flags", f"""SELECT ticker, date, CASE WHEN close <= 0 OR (volume = 0 AND open = high AND high = low AND low = close) THEN 'placeholder'
 WHEN newest AND (TIMESTAMP '2001-10-20 20:30:00' < CAST(date AS TIMESTAMP) + INTERVAL 20 HOUR + CASE WHEN date >= DATE '2001-10-28' THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END OR open > high * 1.000001 OR open < low - 0.000001 * high OR close < low - 0.000001 * high) THEN 'partial' END AS flag
FROM (SELECT *, date = max(date) OVER (PARTITION BY ticker) AS newest FROM ({_FB}) f) x""")
def tsa12(u):
    b = u.bars.withColumns({"open": F.when(F.col("volume") > 60, F.col("close") * 2).otherwise(F.col("open")),
                            "close": F.when(F.col("volume") == 7, 0.0).otherwise(F.col("close")),
                            "volume": F.when(F.col("volume") < 4, 0.0).otherwise(F.col("volume"))})
    return t.bar_flags(b, F.lit("2001-10-20 20:30:00").cast("timestamp")).select("ticker", "date", "flag")


@query("tsa13_quote_change", "SELECT ticker, arg_max(current_price, collected_at) AS current_price, arg_max(current_price - previous_close, collected_at) AS change, arg_max((current_price - previous_close) / previous_close, collected_at) AS change_pct FROM si_snapshots GROUP BY ticker", r="change change_pct")
def tsa13(u):
    return t.quote_change(u.snapshots).select("ticker", "current_price", "change", "change_pct")


@query("tsa14_range_position", "SELECT ticker, greatest(0, least(100, (last - lo) / (hi - lo) * 100)) AS pct FROM (SELECT ticker, arg_max(close, date) AS last, min(low) FILTER (date > m - 365) AS lo, max(high) FILTER (date > m - 365) AS hi FROM si_bars JOIN (SELECT ticker, max(date) AS m FROM si_bars GROUP BY ticker) x USING (ticker) GROUP BY ticker) y", r="pct")
def tsa14(u):
    last = u.bars.groupBy("ticker").agg(F.max("date").alias("m"))
    g = u.bars.join(last, "ticker").groupBy("ticker").agg(
        F.max_by("close", "date").alias("last"), *[f(F.when(F.col("date") > F.date_sub("m", 365), F.col(c))).alias(n) for f, c, n in ((F.min, "low", "lo"), (F.max, "high", "hi"))])
    return g.select("ticker", t.range_position(F.col("last"), F.col("lo"), F.col("hi")).alias("pct"))


@query("tsa15_basis_mismatch", """SELECT x.ticker, x.checked_on, x.stored, s.high AS served, late > 0 OR coalesce(abs(s.high / x.stored - 1) > 0.005, false) AS reload, CASE WHEN late > 0 THEN 'a split or factor after the last stored bar' WHEN abs(s.high / x.stored - 1) > 0.005 THEN 'another basis' END AS reason
FROM (SELECT b.ticker, max(date) FILTER (date < l) AS checked_on, arg_max(close, date) FILTER (date < l) AS stored, any_value(l) AS l FROM si_bars b JOIN (SELECT ticker, max(date) AS l FROM si_bars WHERE date <= DATE '2001-06-30' GROUP BY ticker) m ON b.ticker = m.ticker WHERE date <= DATE '2001-06-30' GROUP BY b.ticker) x
LEFT JOIN si_bars s ON s.ticker = x.ticker AND s.date = x.checked_on LEFT JOIN (SELECT b.ticker, count(d.date) AS late FROM (SELECT ticker, max(date) AS l FROM si_bars WHERE date <= DATE '2001-06-30' GROUP BY ticker) b LEFT JOIN si_splits d ON d.ticker = b.ticker AND d.date > b.l GROUP BY b.ticker) z ON z.ticker = x.ticker""")
def tsa15(u):
    stored = u.bars.where(F.col("date") <= F.lit("2001-06-30").cast("date"))
    served = u.bars.select("ticker", "date", F.col("high").alias("close"))
    return t.basis_mismatch(stored, served, u.splits)


standin.RELATIONS["si_analyst"] = "SELECT ticker, close AS current_price, low * 1.1 AS target_low, (high + low) / 2 * 1.2 AS target_mean, high * 1.3 AS target_high FROM si_bars"


@query("tsa16_analyst_upside", "SELECT *, (target_mean - current_price) / current_price AS upside_potential, target_high - target_low AS target_range FROM si_analyst", r="target_low target_mean target_high upside_potential target_range")
def tsa16(u):
    return t.analyst_upside(u.analyst)


standin.RELATIONS["si_earnings"] = "SELECT ticker, period_end AS quarter, lag(eps_diluted) OVER (PARTITION BY ticker ORDER BY period_end) AS eps_estimate, eps_diluted AS eps_actual, eps_diluted / nullif(lag(eps_diluted) OVER (PARTITION BY ticker ORDER BY period_end), 0) - 1 AS surprise_pct FROM si_quarterly"


@query("tsa17_earnings_history", "SELECT * FROM si_earnings", r="surprise_pct")
def tsa17(u):
    return t.earnings_history(u.earnings)


@query("pit9_close_on_or_before", "SELECT q.ticker, q.period_end AS day, b.date AS date_found, b.close FROM si_quarterly q ASOF LEFT JOIN si_bars b ON q.ticker = b.ticker AND q.period_end >= b.date")
def pit9(u):
    return t.close_on_or_before(u.bars, u.quarterly.select("ticker", F.col("period_end").alias("day"))).select("ticker", "day", "date_found", "close")
