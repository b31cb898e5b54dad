"""Price series: resampling, technical indicators, statistics (TSA-1..17).

Bars are unique per (ticker, date), so a window over one ticker is bounded by trading days; anything
that can be a partial aggregate is one.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finstrata.functions.scale import asof_lookup

# Days of the range keys, trading days in a year, tolerance of the basis check.
RANGE_DAYS = {"1M": 30, "3M": 91, "6M": 182, "1Y": 365, "5Y": 1825}
TRADING_DAYS, BASIS_TOLERANCE = 252, 0.005


def bars_between(bars: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    out = bars
    if start:
        out = out.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        out = out.where(F.col("date") <= F.lit(end).cast("date"))
    return out


def range_start(bars: DataFrame, key: str, today: Column) -> DataFrame:
    """(ticker, start): the key counted back from the earlier of *today* and the ticker's last bar; NULL for MAX."""
    anchor = F.least(today, F.max("date"))
    start = (F.lit(None).cast("date") if key == "MAX" else F.trunc(anchor, "YEAR") if key == "YTD"
             else F.date_sub(anchor, RANGE_DAYS[key]))
    return bars.groupBy("ticker").agg(start.alias("start"))


def auto_interval(key: str) -> str:
    return {"5Y": "1wk", "MAX": "1mo"}.get(key, "1d")


def resample(bars: DataFrame, interval: str) -> DataFrame:
    """Weekly (ending Sunday) or monthly bars: first, max, min, last, sum, dated by the last actual bar."""
    if interval == "1d":
        return bars.select("ticker", "date", "open", "high", "low", "close", "volume")
    period = F.trunc("date", "MM") if interval == "1mo" else F.trunc("date", "WEEK")

    def at(fn, name: str) -> Column:
        return fn(name, F.when(F.col(name).isNotNull(), F.col("date"))).alias(name)

    g = bars.groupBy("ticker", period.alias("__p")).agg(
        F.max("date").alias("date"), at(F.min_by, "open"), F.max("high").alias("high"), F.min("low").alias("low"),
        at(F.max_by, "close"), F.sum("volume").alias("volume"))
    return g.where(F.col("close").isNotNull()).drop("__p")


def sma(bars: DataFrame, n: int, out: str | None = None) -> DataFrame:
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(-(n - 1), 0)
    return bars.withColumn(out or f"ma_{n}", F.when(F.count("date").over(w) == n, F.avg("close").over(w)))


def _recursions(period: int, fast: int, slow: int, signal: int):
    """Per-ticker recursive averages, which a window frame cannot express."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        close = pdf["close"].astype("float64").reset_index(drop=True)
        delta = close.diff()
        gain = delta.clip(lower=0).ewm(alpha=1.0 / period, adjust=False).mean()
        loss = (-delta).clip(lower=0).ewm(alpha=1.0 / period, adjust=False).mean()
        strength = 100.0 * gain / (gain + loss)
        strength = strength.where((gain + loss) != 0, 50.0)
        line = close.ewm(span=fast, adjust=False).mean() - close.ewm(span=slow, adjust=False).mean()
        sig = line.ewm(span=signal, adjust=False).mean()
        warm = close.index
        return pd.DataFrame({
            "ticker": pdf["ticker"].values, "date": pdf["date"].values, "close": close.values,
            "rsi": strength.where(warm >= period).values, "macd": line.where(warm >= slow).values,
            "macd_signal": sig.where(warm >= slow).values, "macd_hist": (line - sig).where(warm >= slow).values})
    return run


def oscillators(bars: DataFrame, period: int = 14, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """Wilder RSI and MACD with signal and histogram; NULL while warming up. A group is one ticker's bars."""
    out = bars.select("ticker", "date", "close").groupBy("ticker").applyInPandas(
        _recursions(period, fast, slow, signal),
        "ticker string, date date, close double, rsi double, macd double, macd_signal double, macd_hist double")
    clean = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("rsi", "macd", "macd_signal", "macd_hist")]
    return out.select("ticker", "date", "close", *clean)


def pct_from_first(bars: DataFrame, out: str = "pct") -> DataFrame:
    """Change against the ticker's first non-NULL close; all NULL when that is zero."""
    first = bars.groupBy("ticker").agg(F.min_by("close", F.when(F.col("close").isNotNull(), F.col("date"))).alias("__base"))
    return bars.join(first, "ticker").withColumn(
        out, F.col("close") / F.nullif(F.col("__base"), F.lit(0.0)) - 1.0).drop("__base")


def indicator_bundle(bars: DataFrame, start: str | None = None) -> DataFrame:
    """Moving averages and oscillators on the whole history, sliced afterwards."""
    full = sma(sma(oscillators(bars), 50), 200)
    return bars_between(full, start)


def compare_rebased(bars: DataFrame, tickers: DataFrame, start: str | None = None) -> DataFrame:
    """Percent change of each wanted ticker from the first date all of them have."""
    b = bars_between(bars, start).join(tickers.select("ticker").distinct(), "ticker", "left_semi")
    firsts = b.where(F.col("close").isNotNull()).groupBy("ticker").agg(F.min("date").alias("f"))
    shared = firsts.agg(F.max("f").alias("__shared"))
    kept = b.crossJoin(F.broadcast(shared)).where(F.col("date") >= F.col("__shared")).drop("__shared")
    return pct_from_first(kept).select("ticker", "date", "close", "pct")


def price_stats(bars: DataFrame, risk_free: float = 0.04) -> DataFrame:
    """Return, CAGR (252-day years), volatility, drawdown, Sharpe estimate, highs, lows and volume per ticker."""
    w = Window.partitionBy("ticker").orderBy("date")
    d = bars.where(F.col("close").isNotNull()).select(
        "ticker", "date", "close", "volume", (F.col("close") / F.lag("close").over(w) - 1).alias("__r"),
        (F.col("close") / F.max("close").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).alias("__dd"))
    n, first, last = F.count("*"), F.min_by("close", "date"), F.max_by("close", "date")
    vol = F.stddev_samp("__r")
    year = F.lit(float(TRADING_DAYS))
    return d.groupBy("ticker").agg(
        F.min("date").alias("start_date"), F.max("date").alias("end_date"), n.alias("trading_days"),
        last.alias("latest_close"), F.max("close").alias("period_high"), F.min("close").alias("period_low"),
        F.avg("close").alias("period_avg"), F.when(n > 1, last / first - 1).alias("total_return"),
        F.when((n > 1) & (first > 0), F.pow(last / first, year / n) - 1).alias("cagr"), vol.alias("daily_volatility"),
        (vol * F.sqrt(year)).alias("annual_volatility"), F.when(n > 1, F.min("__dd")).alias("max_drawdown"),
        F.when((F.count("__r") >= 30) & (vol != 0), (F.avg("__r") * year - risk_free) / (vol * F.sqrt(year))).alias("sharpe"),
        F.avg("volume").alias("avg_volume"), F.stddev_samp("volume").alias("volume_volatility"))


def annual_returns(bars: DataFrame) -> DataFrame:
    """Year-end close over the year before's."""
    y = bars.where(F.col("close").isNotNull()).groupBy("ticker", F.year("date").alias("year")).agg(F.max_by("close", "date").alias("close"))
    w = Window.partitionBy("ticker").orderBy("year")
    return y.withColumn("annual_return", F.col("close") / F.lag("close").over(w) - 1).where(F.col("annual_return").isNotNull())


def annual_dividends(dividends: DataFrame) -> DataFrame:
    """Yearly sums, with the years between the first and last payment that paid nothing at 0."""
    y = dividends.groupBy("ticker", F.year("date").alias("year")).agg(F.sum("amount").alias("amount"))
    span = y.groupBy("ticker").agg(F.explode(F.sequence(F.min("year"), F.max("year"))).alias("year"))
    return span.join(y, ["ticker", "year"], "left").select("ticker", "year", F.coalesce("amount", F.lit(0.0)).alias("amount"))


def dividend_stats(dividends: DataFrame) -> DataFrame:
    """Payments, years, growth, and the share of paying years that did not cut."""
    y = annual_dividends(dividends)
    w = Window.partitionBy("ticker").orderBy("year")
    paying = y.where(F.col("amount") > 0).withColumn("__up", (F.col("amount") >= F.lag("amount").over(w)).cast("int"))
    g = paying.groupBy("ticker").agg(
        F.min_by("amount", "year").alias("__first"), F.max_by("amount", "year").alias("__last"),
        F.coalesce(F.sum("__up"), F.lit(0)).alias("__inc"), F.count("*").alias("__paying"))
    total = y.groupBy("ticker").agg(F.count("*").alias("__years"))
    p = dividends.groupBy("ticker").agg(F.count("*").alias("payments"), F.datediff(F.max("date"), F.min("date")).alias("__days"))
    many = F.col("__years") >= 2
    return (p.join(total, "ticker").join(g, "ticker", "left").select(
        "ticker", "payments", (F.col("__days") / 365.25).alias("years_of_data"),
        F.when(many, F.pow(F.col("__last") / F.col("__first"), 1.0 / F.nullif(F.col("__years") - 1, F.lit(0))) - 1).alias("dividend_cagr"),
        F.when(many, F.col("__inc")).alias("dividend_increases"),
        F.when(many & (F.col("__paying") > 1), F.col("__inc") / F.nullif(F.col("__paying") - 1, F.lit(0))).alias("dividend_consistency")))


def bar_flags(bars: DataFrame, taken: Column) -> DataFrame:
    """placeholder / partial / NULL per bar; *taken*: when the newest bars were stored (UTC timestamp)."""
    newest = bars.groupBy("ticker").agg(F.max("date").alias("__newest"))
    close_utc = F.to_utc_timestamp(F.to_timestamp(F.concat(F.col("date").cast("string"), F.lit(" 16:00:00"))), "America/New_York")
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    slack = 1e-6 * F.abs(h)
    broken = (o > h + slack) | (o < lo - slack) | (c > h + slack) | (c < lo - slack)
    flat = (F.coalesce(F.col("volume"), F.lit(0.0)) == 0) & o.eqNullSafe(h) & h.eqNullSafe(lo) & lo.eqNullSafe(c)
    is_new = F.col("date") == F.col("__newest")
    flag = (F.when(c.isNull() | (c <= 0) | flat, "placeholder")
            .when(is_new & ((taken < close_utc) | F.coalesce(broken, F.lit(False))), "partial"))
    return bars.join(newest, "ticker").withColumn("flag", flag).drop("__newest")


def quote_change(snapshots: DataFrame) -> DataFrame:
    """The latest snapshot of each ticker with its change and change in percent of the previous close."""
    cols = [c for c in snapshots.columns if c != "ticker"]
    last = snapshots.groupBy("ticker").agg(F.max_by(F.struct(*cols), "collected_at").alias("s")).select("ticker", "s.*")
    ok = F.col("current_price").isNotNull() & (F.col("previous_close") != 0)
    change = F.when(ok, F.col("current_price") - F.col("previous_close"))
    return last.withColumns({"change": change, "change_pct": change / F.nullif(F.col("previous_close"), F.lit(0.0))})


def range_position(price: Column, low: Column, high: Column) -> Column:
    """0..100 of a price within its range; NULL for a degenerate range."""
    pct = (price - low) / F.nullif(high - low, F.lit(0.0)) * 100.0
    return F.when(pct.isNotNull(), F.greatest(F.least(pct, F.lit(100.0)), F.lit(0.0)))


def basis_mismatch(bars: DataFrame, served: DataFrame, splits: DataFrame) -> DataFrame:
    """Whether each ticker's served closes are on the stored bars' basis: (ticker, reload, reason).

    The close checked is the latest stored one before the last bar; a split or factor after the last stored bar
    always calls for a reload.
    """
    last = bars.groupBy("ticker").agg(F.max("date").alias("last_bar"))
    j = bars.join(last, "ticker")
    before = j.where((F.col("date") < F.col("last_bar")) & (F.col("close") > 0)).groupBy("ticker").agg(
        F.max("date").alias("date"), F.max_by("close", "date").alias("stored"))
    s = served.select("ticker", "date", F.col("close").alias("served"))
    late = splits.join(last, "ticker").where(F.col("date") > F.col("last_bar")).groupBy("ticker").agg(F.count("*").alias("late"))
    c = last.join(before, "ticker", "left").join(s, ["ticker", "date"], "left").join(late, "ticker", "left")
    off = F.abs(F.col("served") / F.nullif(F.col("stored"), F.lit(0.0)) - 1.0) > BASIS_TOLERANCE
    reason = F.when(F.col("late") > 0, "a split or factor after the last stored bar").when(off, "another basis")
    return c.select("ticker", F.col("date").alias("checked_on"), "stored", "served", reason.isNotNull().alias("reload"), reason.alias("reason"))


def analyst_upside(analyst: DataFrame) -> DataFrame:
    price = F.nullif(F.col("current_price"), F.lit(0.0))
    return analyst.withColumns({
        "upside_potential": F.when(F.col("target_mean") != 0, (F.col("target_mean") - price) / price),
        "target_range": F.when((F.col("target_low") != 0) & (F.col("target_high") != 0), F.col("target_high") - F.col("target_low"))})


def earnings_history(earnings: DataFrame) -> DataFrame:
    return earnings.select("ticker", "quarter", "eps_estimate", "eps_actual", "surprise_pct").orderBy("ticker", "quarter")


def close_on_or_before(bars: DataFrame, probes: DataFrame) -> DataFrame:
    """PIT-9: adds the close of the latest bar on or before each probe's ``day``, and that bar's date."""
    return asof_lookup(probes, bars.where(F.col("close").isNotNull()).select("ticker", "date", "close"), ["ticker"], "day", "date", ["close"])
