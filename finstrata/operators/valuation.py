"""Fair-value models per company (VAL-1..20) and the other indicators (IND-1..6).

A company is one row whose ``years`` array holds its latest fiscal years (ten at most, oldest first), so
every model is an expression over a short array and the whole set runs in one stage after the inputs
are assembled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finstrata.functions.exprs import array_median, array_quantile, clamp, zero_if_null
from finstrata.functions.scale import asof_lookup

# Fixed values of the models.
GROWTH_CAP, DDM_GROWTH_CAP, TERMINAL_GROWTH, ERP = 0.15, 0.10, 0.025, 0.045
DISCOUNT_FLOOR, DISCOUNT_CAP, GROWTH_SPREAD, DISCOUNT_SPREAD = 0.08, 0.14, 0.03, 0.01
DEFAULT_BETA, DEFAULT_RF, OE_DISCOUNT_FLOOR, MARGIN_OF_SAFETY = 1.0, 0.045, 0.07, 0.30
OE_MIN_POSITIVE_YEARS, OE_HISTORY_WINDOW, MIN_FYS_FROM_FIRST_POSITIVE = 8, 10, 4
DIVIDEND_STALE_DAYS, DIVIDEND_CAGR_YEARS, MAX_BASIS_AGE_FYS = 456, 10, 2
ONE_PAYMENT_TOLERANCE, REGULAR_PAYMENT_SHARE, ONE_OFF_MULTIPLE = 0.02, 0.5, 3.0
ONE_OFF_RECURS_IN, ONE_OFF_LOOKBACK_YEARS, ONE_OFF_SEASON_DAYS, ONE_OFF_SLOT_INTERVALS = 2, 3, 91, 1.5
LYNCH_PE_FLOOR, LYNCH_PE_CAP, GRAHAM_MULTIPLIER = 5.0, 25.0, 22.5
DCF_SECTORS = ("general", "utility", "energy")
MEDIAN_MODELS = ("dcf", "ddm", "graham", "lynch", "multiples")
REVERSE_LOW, REVERSE_HIGH, REVERSE_TOLERANCE = -0.5, 1.0, 1e-7
EPV_YEARS, EPV_MIN_YEARS, EPV_WACC_SPREAD = 5, 3, 0.01
NNWC_RECEIVABLES, NNWC_INVENTORY, NETNET_BUY = 0.75, 0.5, 2 / 3

YEAR_FIELDS = ("period_end fcf eps bvps ffo_ps net_income depreciation_amortization capex shares "
               "dividends_per_share price").split()


# ---- growth and discount

def derive_growth(history: Column, cap: float = GROWTH_CAP) -> tuple[Column, Column]:
    """(base growth in [0, cap], source) from an array of (y, v), oldest first, without NULL values."""
    def span_cagr(first: Column) -> Column:
        last = F.element_at(history, -1)
        span = last["y"] - first["y"]
        return F.when((first["v"] > 0) & (last["v"] > 0) & (span > 0),
                      F.pow(last["v"] / F.nullif(first["v"], F.lit(0.0)), F.lit(1.0) / F.nullif(span, F.lit(0)).cast("double")) - 1.0)

    whole = F.when(F.size(history) >= 2, span_cagr(F.get(history, F.lit(0))))
    first_positive = F.get(F.filter(history, lambda s: s["v"] > 0), F.lit(0))
    left = F.size(F.filter(history, lambda s: s["y"] >= first_positive["y"]))
    later = F.when(left >= MIN_FYS_FROM_FIRST_POSITIVE, span_cagr(first_positive))
    source = F.when(whole.isNotNull(), "hist_only").when(later.isNotNull(), "hist_from_first_positive").otherwise("none")
    return clamp(F.coalesce(whole, later, F.lit(0.0)), 0.0, cap), source


def discount_rate(risk_free: Column, beta: Column) -> Column:
    """CAPM cost of equity within its floor and cap."""
    raw = F.coalesce(risk_free, F.lit(DEFAULT_RF)) + F.coalesce(beta, F.lit(DEFAULT_BETA)) * ERP
    return clamp(raw, DISCOUNT_FLOOR, DISCOUNT_CAP)


def growth_scenarios(base: Column, cap: float = GROWTH_CAP) -> tuple[Column, Column, Column]:
    return F.greatest(base - GROWTH_SPREAD, F.lit(0.0)), base, F.least(base + GROWTH_SPREAD, F.lit(cap))


def dcf_per_share(fcf: Column, shares: Column, growth: Column, discount: Column,
                  terminal: float = TERMINAL_GROWTH) -> Column:
    """Ten years of cash flow (five at *growth*, five fading to *terminal*) and a Gordon value, per share."""
    def step(acc: Column, t: Column) -> Column:
        rate = F.when(t <= 5, growth).otherwise(growth + (terminal - growth) * (t - 5) / 5.0)
        cash = acc["cash"] * (1.0 + rate)
        return F.struct(cash.alias("cash"), (acc["value"] + cash / F.pow(1.0 + discount, t.cast("double"))).alias("value"))

    start = F.struct(fcf.cast("double").alias("cash"), F.lit(0.0).alias("value"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(10)), start, step)
    last = end["cash"] * (1.0 + terminal) / (discount - terminal)
    return (end["value"] + last / F.pow(1.0 + discount, F.lit(10.0))) / F.nullif(shares, F.lit(0.0))


def ddm_per_share(dps: Column, growth: Column, discount: Column, terminal: float = TERMINAL_GROWTH) -> Column:
    """Five years of dividends at *growth* and a Gordon value."""
    paid = [dps * F.pow(1.0 + growth, F.lit(float(t))) for t in range(1, 6)]
    value = reduce(lambda a, b: a + b, [p / F.pow(1.0 + discount, F.lit(float(t))) for t, p in enumerate(paid, 1)])
    return value + paid[-1] * (1.0 + terminal) / (discount - terminal) / F.pow(1.0 + discount, F.lit(5.0))


# ---- inputs

def fiscal_end_prices(annual: DataFrame, bars: DataFrame) -> DataFrame:
    """Adds ``price``: the close on or before each fiscal year's end."""
    probes = annual.where(F.col("period_end").isNotNull())
    return asof_lookup(probes, bars.select("ticker", "date", F.col("close").alias("price")), ["ticker"],
                       "period_end", "date", ["price"]).drop("date_found")


def valuation_inputs(annual: DataFrame, companies: DataFrame, market: DataFrame, max_years: int = 10) -> DataFrame:
    """One row per company: the ``years`` array and the market's figures.

    *annual*: per fiscal year the columns of ``YEAR_FIELDS``; *market*: ticker, shares_outstanding,
    current_price, market_cap, beta, risk_free_rate. A company has few fiscal years, so the list is bounded.
    """
    w = Window.partitionBy("ticker").orderBy(F.desc("fiscal_year"))
    rows = annual.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= max_years)
    packed = rows.groupBy("ticker").agg(F.array_sort(F.collect_list(
        F.struct("fiscal_year", *YEAR_FIELDS))).alias("years"))
    return (companies.select("ticker", F.coalesce("sector_class", F.lit("general")).alias("sector_class"))
            .join(packed, "ticker", "left")
            .withColumn("years", F.coalesce("years", F.array().cast(packed.schema["years"].dataType)))
            .join(market, "ticker", "left"))


def _with(field: str) -> Column:
    return F.filter("years", lambda r: r[field].isNotNull())


def _history(field: str) -> Column:
    return F.transform(_with(field), lambda r: F.struct(r["fiscal_year"].alias("y"), r[field].cast("double").alias("v")))


def _tail_median(values: Column, n: int = 3) -> Column:
    return array_median(F.transform(F.slice(values, F.greatest(F.size(values) - n + 1, F.lit(1)), F.lit(n)), lambda s: s["v"]))


def _count(field_rows: Column) -> Column:
    """Today's share count, else the latest of the given years that has one."""
    filed = F.element_at(F.filter(field_rows, lambda r: r["shares"] > 0), -1)["shares"]
    return F.when(F.col("shares_outstanding") > 0, F.col("shares_outstanding")).otherwise(
        F.when(F.size(F.filter(field_rows, lambda r: r["shares"] > 0)) > 0, filed))


RESULT = ("ticker model applicable na_reason value_bear value_base value_bull basis_fiscal_year growth_base "
          "growth_source discount_base basis shares_used").split()


def _result(inputs: DataFrame, model: str, reasons: list[tuple[Column, Column | str]], values: tuple[Column, Column, Column],
            basis_fy: Column, stale_from: Column | None = None, **extra: Column) -> DataFrame:
    """A model's rows: the first reason that holds makes the row N/A; a stale basis does too (``as_of`` given)."""
    chain = F.lit(None).cast("string")
    for cond, text in reversed(reasons):
        chain = F.when(cond, text if isinstance(text, Column) else F.lit(text)).otherwise(chain)
    if stale_from is not None:
        stale = F.when(F.year(stale_from) - basis_fy > MAX_BASIS_AGE_FYS, F.format_string(
            f"basis FY%d is more than {MAX_BASIS_AGE_FYS} fiscal years old", basis_fy))
        chain = F.coalesce(chain, stale)
    d = inputs.withColumn("__reason", chain)
    ok = F.col("__reason").isNull()
    defaults = {"growth_base": "double", "growth_source": "string", "discount_base": "double", "basis": "double",
                "shares_used": "double"}
    more = [F.when(ok, extra[k]).cast(t).alias(k) if k in extra else F.lit(None).cast(t).alias(k)
            for k, t in defaults.items()]
    return d.select("ticker", F.lit(model).alias("model"), ok.alias("applicable"), F.col("__reason").alias("na_reason"),
                    *[F.when(ok, v).cast("double").alias(f"value_{n}") for n, v in zip(("bear", "base", "bull"), values)],
                    basis_fy.cast("int").alias("basis_fiscal_year"), *more)


def _sector_reason() -> tuple[Column, Column]:
    return (~F.col("sector_class").isin(*DCF_SECTORS),
            F.concat(F.lit("not applicable to sector '"), F.col("sector_class"), F.lit("'")))


def _last_year(rows: Column) -> Column:
    return F.when(F.size(rows) > 0, F.get(rows, F.size(rows) - 1)["fiscal_year"])


# ---- models

def value_dcf(inputs: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Free-cash-flow DCF of operating companies: median of the last three years' cash flow."""
    d = inputs.withColumns({"__h": _history("fcf"), "__rows": _with("fcf")})
    basis, shares = _tail_median(F.col("__h")), _count(F.col("__rows"))
    growth, source = derive_growth(F.col("__h"))
    d = d.withColumns({"__basis": basis, "__shares": shares, "__g": growth, "__src": source,
                       "__r": discount_rate(F.col("risk_free_rate"), F.col("beta"))})
    bear, base, bull = growth_scenarios(F.col("__g"))
    args = (F.col("__basis"), F.col("__shares"))
    r = F.col("__r")
    reasons = [_sector_reason(), (F.size("__rows") < 4, "insufficient FCF history (need >= 4 fiscal years)"),
               (F.col("__basis") <= 0, "median 3-year FCF is not positive"),
               (F.col("__shares").isNull(), "shares outstanding unavailable")]
    fy = F.when(F.col("sector_class").isin(*DCF_SECTORS) & (F.size("__rows") >= 4), _last_year(F.col("__rows")))
    return _result(d, "dcf", reasons, (dcf_per_share(*args, bear, r + DISCOUNT_SPREAD), dcf_per_share(*args, base, r),
                                       dcf_per_share(*args, bull, r - DISCOUNT_SPREAD)), fy, as_of,
                   growth_base=F.col("__g"), growth_source=F.col("__src"), discount_base=r, basis=F.col("__basis"),
                   shares_used=F.col("__shares"))


def value_graham(inputs: DataFrame, as_of: Column | None = None) -> DataFrame:
    """sqrt(22.5 x EPS x book per share) on the latest year; bear and bull from three years' EPS."""
    d = inputs.withColumn("__n", F.get("years", F.size("years") - 1))
    any_row = F.size(F.filter("years", lambda r: r["eps"].isNotNull() & r["bvps"].isNotNull())) > 0
    last3 = F.filter(F.transform(F.slice("years", F.greatest(F.size("years") - 2, F.lit(1)), F.lit(3)), lambda r: r["eps"]),
                     lambda e: e.isNotNull())
    loss = F.exists(last3, lambda e: e <= 0)
    eps, bvps = F.col("__n.eps"), F.col("__n.bvps")
    fy = F.when(any_row, F.col("__n.fiscal_year"))
    reasons = [(~any_row, "EPS or book value unavailable"),
               (eps.isNull(), F.format_string("EPS unavailable for the latest fiscal year (FY%d)", F.col("__n.fiscal_year"))),
               (bvps.isNull(), F.format_string("book value per share unavailable for the latest fiscal year (FY%d)",
                                               F.col("__n.fiscal_year"))),
               (eps <= 0, "EPS is not positive"), (bvps <= 0, "book value per share is not positive")]

    def number(e: Column) -> Column:
        return F.when((e > 0) & (bvps > 0), F.sqrt(F.greatest(GRAHAM_MULTIPLIER * e * bvps, F.lit(0.0))))

    return _result(d, "graham", reasons, (number(F.when(~loss, F.array_min(last3))), number(eps), number(F.array_max(last3))),
                   fy, as_of, basis=bvps)


def value_lynch(inputs: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Growth in percent (5 to 25) as the fair P/E of the latest EPS."""
    d = inputs.withColumns({"__h": _history("eps"), "__rows": _with("eps")})
    growth, source = derive_growth(F.col("__h"))
    d = d.withColumns({"__g": growth, "__src": source, "__eps": F.get("__h", F.size("__h") - 1)["v"]})
    reasons = [_sector_reason(), (F.size("__rows") < 4, "insufficient EPS history (need >= 4 fiscal years)"),
               (F.col("__eps") <= 0, "EPS is not positive"),
               (F.col("__src") == "none", "no usable earnings-growth history")]
    fy = F.when(F.col("sector_class").isin(*DCF_SECTORS) & (F.size("__rows") >= 4), _last_year(F.col("__rows")))
    values = tuple(clamp(g * 100.0, LYNCH_PE_FLOOR, LYNCH_PE_CAP) * F.col("__eps") for g in growth_scenarios(F.col("__g")))
    return _result(d, "lynch", reasons, values, fy, as_of, growth_base=F.col("__g"), growth_source=F.col("__src"),
                   basis=F.col("__eps"))


def value_multiples(inputs: DataFrame, as_of: Column | None = None) -> DataFrame:
    """The quartiles of the company's own five-year P/E, P/B (banks, insurers) or P/FFO (REITs)."""
    def basis(r: Column) -> Column:
        return (F.when(F.col("sector_class").isin("bank", "insurance"), r["bvps"])
                .when(F.col("sector_class") == "reit", r["ffo_ps"]).otherwise(r["eps"]))

    five = F.slice("years", F.greatest(F.size("years") - 4, F.lit(1)), F.lit(5))
    band = F.filter(F.transform(five, lambda r: F.when((basis(r) > 0) & (r["price"] > 0), r["price"] / F.nullif(basis(r), F.lit(0.0)))),
                    lambda m: m.isNotNull())
    d = inputs.withColumn("__m", F.array_sort(band))
    d = d.withColumn("__b", basis(F.get("years", F.size("years") - 1)))
    reasons = [(F.size("__m") < 3, "insufficient multiple history (need >= 3 fiscal years)"),
               (~(F.coalesce(F.col("__b"), F.lit(0.0)) > 0), "latest per-share basis is not positive")]
    fy = F.when(F.size("__m") >= 3, _last_year(F.col("years")))
    return _result(d, "multiples", reasons, tuple(array_quantile(F.col("__m"), q) * F.col("__b") for q in (0.25, 0.5, 0.75)),
                   fy, as_of, basis=F.col("__b"))


def owner_earnings_of(r: Column) -> Column:
    """Net income + D&A - min(D&A, |capex|) of one year."""
    da = r["depreciation_amortization"]
    return r["net_income"] + da - F.least(da, F.coalesce(F.abs(r["capex"]), da))


def owner_history(years: Column | str = "years") -> Column:
    return F.filter(F.transform(years, lambda r: F.struct(
        r["fiscal_year"].alias("y"), owner_earnings_of(r).alias("v"), r["shares"].alias("shares"))),
        lambda s: s["v"].isNotNull())


def owner_volatility(h: Column) -> dict[str, Column]:
    """Collapse years against the trailing three-year median, the deepest yearly fall, and the sign record."""
    n = F.size(h)
    later = F.when(n >= 2, F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    drops = F.transform(later, lambda i: F.when(
        (F.get(h, i - 1)["v"] > 0) & (F.get(h, i)["v"] < F.get(h, i - 1)["v"]),
        F.least(F.lit(1.0), (F.get(h, i - 1)["v"] - F.get(h, i)["v"]) / F.nullif(F.get(h, i - 1)["v"], F.lit(0.0)))))
    fourth = F.filter(later, lambda i: i >= 3)
    falls = F.filter(fourth, lambda i: (F.get(h, i)["v"] <= 0) | (
        (array_median(F.transform(F.slice(h, i - 2, F.lit(3)), lambda s: s["v"])) > 0)
        & (F.get(h, i)["v"] < 0.5 * array_median(F.transform(F.slice(h, i - 2, F.lit(3)), lambda s: s["v"])))))
    return {"collapse_years": F.size(falls), "worst_drop": F.coalesce(F.array_max(drops), F.lit(0.0)),
            "positive_years": F.size(F.filter(h, lambda s: s["v"] > 0)), "total_years": n}


def owner_earnings_volatility(inputs: DataFrame) -> DataFrame:
    d = inputs.withColumn("__h", owner_history())
    d = d.withColumn("__h", F.slice("__h", F.greatest(F.size("__h") - OE_HISTORY_WINDOW + 1, F.lit(1)), F.lit(OE_HISTORY_WINDOW)))
    return d.select("ticker", *[c.alias(k) for k, c in owner_volatility(F.col("__h")).items()])


def value_owner_earnings(inputs: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Owner earnings discounted at the Treasury rate (7 % at least), growth varied, rate fixed."""
    d = inputs.withColumn("__all", owner_history())
    d = d.withColumn("__h", F.slice("__all", F.greatest(F.size("__all") - OE_HISTORY_WINDOW + 1, F.lit(1)), F.lit(OE_HISTORY_WINDOW)))
    growth, source = derive_growth(F.col("__h"))
    filed = F.filter("__all", lambda r: r["shares"] > 0)
    shares = F.when(F.col("shares_outstanding") > 0, F.col("shares_outstanding")).otherwise(
        F.get(filed, F.size(filed) - 1)["shares"])
    d = d.withColumns({"__basis": _tail_median(F.col("__h")), "__g": growth, "__src": source, "__shares": shares,
                       "__pos": F.size(F.filter("__h", lambda s: s["v"] > 0)),
                       "__r": F.greatest(F.coalesce(F.col("risk_free_rate"), F.lit(OE_DISCOUNT_FLOOR)), F.lit(OE_DISCOUNT_FLOOR))})
    reasons = [_sector_reason(), (F.size("__all") < 4, "insufficient history (need >= 4 fiscal years)"),
               (F.size("__h") < OE_HISTORY_WINDOW,
                "insufficient history for the predictability test (need >= 10 fiscal years)"),
               (F.col("__pos") < OE_MIN_POSITIVE_YEARS, "owner earnings too erratic to forecast"),
               (F.col("__basis") <= 0, "median 3-year owner earnings is not positive"),
               (F.col("__shares").isNull(), "shares outstanding unavailable")]
    values = tuple(dcf_per_share(F.col("__basis"), F.col("__shares"), g, F.col("__r")) for g in growth_scenarios(F.col("__g")))
    fy = F.when(F.col("sector_class").isin(*DCF_SECTORS) & (F.size("__all") >= 4), F.get("__all", F.size("__all") - 1)["y"])
    return _result(d, "owner_earnings", reasons, values, fy, as_of, growth_base=F.col("__g"), growth_source=F.col("__src"),
                   discount_base=F.col("__r"), basis=F.col("__basis"), shares_used=F.col("__shares"))


# ---- dividends

def one_off_dividends(dividends: DataFrame) -> DataFrame:
    """The part of each payment outside the regular schedule: (ticker, date, amount, one_off, whole).

    One payment per (ticker, date); every frame is bounded by days.
    """
    by_day = Window.partitionBy("ticker").orderBy(F.unix_date("date"))
    seq = Window.partitionBy("ticker").orderBy("date")
    d = dividends.select("ticker", "date", "amount").withColumns({
        "__before": F.collect_list("amount").over(by_day.rangeBetween(-364, -1)),
        "__after": F.collect_list("amount").over(by_day.rangeBetween(1, 365)),
        "__earlier": F.collect_list(F.struct("date", "amount")).over(
            by_day.rangeBetween(-365 * ONE_OFF_LOOKBACK_YEARS - ONE_OFF_SEASON_DAYS, -1)),
        "__prev": F.lag("date").over(seq), "__next": F.lead("date").over(seq)})
    usual = (d.where(F.col("__prev").isNotNull()).groupBy("ticker")
             .agg(F.percentile(F.datediff("date", "__prev"), 0.5).alias("__usual")))
    d = d.join(usual, "ticker", "left").withColumns({"__lb": array_median(F.col("__before")), "__la": array_median(F.col("__after"))})
    regular = F.least("__lb", "__la")
    seasons = reduce(lambda a, b: a + b, [F.when(F.exists("__earlier", lambda s: (s["amount"] > ONE_OFF_MULTIPLE * regular) & (
        F.abs(F.datediff(s["date"], F.date_sub(F.col("date"), 365 * k))) <= ONE_OFF_SEASON_DAYS)), 1).otherwise(0)
        for k in range(1, ONE_OFF_LOOKBACK_YEARS + 1)])
    large = (F.size("__before") > 0) & (F.size("__after") > 0) & (F.col("amount") > ONE_OFF_MULTIPLE * F.greatest("__lb", "__la"))
    slot = F.coalesce(F.datediff("__next", "__prev") > ONE_OFF_SLOT_INTERVALS * F.col("__usual"), F.lit(False))
    off = F.when(large & (seasons < ONE_OFF_RECURS_IN), F.when(slot, F.col("amount") - regular).otherwise(F.col("amount")))
    return d.select("ticker", "date", "amount", off.alias("one_off"), (off == F.col("amount")).alias("whole"))


def dividend_years(inputs: DataFrame, dividends: DataFrame) -> DataFrame:
    """Each fiscal year's dividends per share: the filed figure unless it is one payment, else the year's payments.

    *dividends*: output of ``one_off_dividends``.
    """
    y = inputs.select("ticker", F.explode(F.slice("years", F.greatest(F.size("years") - DIVIDEND_CAGR_YEARS + 1, F.lit(1)),
                                                  F.lit(DIVIDEND_CAGR_YEARS))).alias("r"))
    y = y.select("ticker", "r.fiscal_year", "r.period_end", F.col("r.dividends_per_share").alias("filed"))
    w = Window.partitionBy("ticker").orderBy("fiscal_year")
    follows = F.lag("fiscal_year").over(w) == F.col("fiscal_year") - 1
    y = y.withColumn("start", F.when(follows, F.lag("period_end").over(w)).otherwise(F.date_sub("period_end", 365)))
    p = dividends.select("ticker", "date", "amount", "one_off", F.coalesce("whole", F.lit(False)).alias("whole"))
    # Spans of one company are consecutive, so a payment meets its own year and the two beside it.
    j = y.join(p, "ticker", "left").where(F.col("date").isNull() | (F.col("date") <= F.date_add("period_end", 365)))
    inside = (F.col("date") > F.col("start")) & (F.col("date") <= F.col("period_end"))
    before = (F.col("date") > F.date_sub("start", 365)) & (F.col("date") <= F.col("start")) & ~F.col("whole")
    after = (F.col("date") > F.col("period_end")) & (F.col("date") <= F.date_add("period_end", 365)) & ~F.col("whole")
    g = j.groupBy("ticker", "fiscal_year", "period_end", "start", "filed").agg(
        F.collect_list(F.when(inside, F.struct("date", "amount"))).alias("paid"),
        F.sum(F.when(inside, F.col("one_off"))).alias("one_off"),
        F.max(F.when(F.col("date") <= F.col("start"), F.col("date"))).alias("prev_paid"),
        F.collect_list(F.when(before, F.col("amount"))).alias("__b"), F.collect_list(F.when(after, F.col("amount"))).alias("__a"))
    amounts = F.transform("paid", lambda s: s["amount"])

    def regular(arr: str) -> Column:
        return F.size(F.filter(arr, lambda a: a >= REGULAR_PAYMENT_SHARE * array_median(F.col(arr))))

    first = F.array_min(F.transform("paid", lambda s: s["date"]))
    one_payment = (F.size("paid") >= 2) & (F.greatest(regular("__b"), regular("__a")) >= 2) & (
        (F.col("filed") < F.array_min(amounts)) | F.exists(amounts, lambda a: F.abs(F.col("filed") - a) <= ONE_PAYMENT_TOLERANCE * a))
    use_filed = (F.col("filed") > 0) & ~one_payment
    total = F.aggregate(F.array_sort("paid"), F.lit(0.0), lambda s, x: s + x["amount"])
    g = g.withColumns({
        "amount": F.when(F.coalesce(use_filed, F.lit(False)), F.col("filed")).when(F.size("paid") > 0, total),
        "source": F.when(F.coalesce(use_filed, F.lit(False)), "filed").when(F.size("paid") > 0, "payments"),
        "restart": (F.size("paid") == 0) | F.col("prev_paid").isNull() | (F.datediff(first, "prev_paid") > DIVIDEND_STALE_DAYS),
        "one_off": F.coalesce("one_off", F.lit(0.0)), "paid_total": total})
    holds = (F.col("one_off") != 0) & (F.col("amount") > F.col("paid_total") - F.col("one_off") / 2)
    return g.select("ticker", "fiscal_year", "amount", "source", F.coalesce("restart", F.lit(True)).alias("restart"), "one_off",
                    F.when(holds, F.col("amount") - F.col("one_off")).otherwise(F.col("amount")).alias("regular_amount"),
                    F.size("paid").alias("payments"))


def growth_years(years: DataFrame) -> DataFrame:
    """The paying years from the first that neither starts nor restarts; none when fewer than four remain."""
    w = Window.partitionBy("ticker")
    ok = F.col("amount").isNotNull() & ~F.col("restart")
    d = years.withColumn("__from", F.min(F.when(ok, F.col("fiscal_year"))).over(w))
    d = d.where((F.col("fiscal_year") >= F.col("__from")) & F.col("amount").isNotNull())
    return d.withColumn("__n", F.count("*").over(w)).where(F.col("__n") >= 4).drop("__from", "__n")


def value_ddm(inputs: DataFrame, dividends: DataFrame, as_of: Column, gaps: DataFrame | None = None) -> DataFrame:
    """Dividend discount model on the trailing year's regular payments.

    *gaps* (ticker, fiscal_year, gap_from, gap_to): years whose payment record is incomplete.
    """
    marked = one_off_dividends(dividends)
    gy = growth_years(dividend_years(inputs, marked))
    w = Window.partitionBy("ticker")
    ends = (F.col("fiscal_year") == F.min("fiscal_year").over(w)) | (F.col("fiscal_year") == F.max("fiscal_year").over(w))
    hist = (gy.withColumn("__v", F.when(ends, F.col("regular_amount")).otherwise(F.col("amount")))
            .groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct(F.col("fiscal_year").alias("y"), F.col("__v").alias("v")))).alias("__h"),
                                   F.collect_list(F.when(F.col("source") == "payments", F.col("fiscal_year"))).alias("__own")))
    in_ttm = (F.col("date") > F.date_sub(as_of, 365)) & (F.col("date") <= as_of)
    totals = marked.groupBy("ticker").agg(
        F.countDistinct(F.year("date")).alias("__years"), F.max("date").alias("__last"),
        (F.coalesce(F.sum(F.when(in_ttm, F.col("amount"))), F.lit(0.0))
         - F.coalesce(F.sum(F.when(in_ttm, F.col("one_off"))), F.lit(0.0))).alias("__ttm"))
    d = inputs.join(totals, "ticker", "left").join(hist, "ticker", "left")
    empty = F.array().cast("array<struct<y:int,v:double>>")
    d = d.withColumn("__h", F.coalesce("__h", empty))
    missing = F.lit(None).cast("string")
    if gaps is not None:
        listed = gaps.groupBy("ticker").agg(F.collect_list(F.struct("fiscal_year", "gap_from", "gap_to")).alias("__gaps"))
        d = d.join(listed, "ticker", "left")
        hit = F.filter("__gaps", lambda x: F.coalesce(F.array_contains("__own", x["fiscal_year"]), F.lit(False)) | (
            (x["gap_to"] > F.date_sub(as_of, 365)) & (x["gap_from"] < as_of)))
        years = F.array_join(F.transform(F.array_sort(hit), lambda x: F.concat(F.lit("FY"), x["fiscal_year"].cast("string"))), ", ")
        missing = F.when(F.size(hit) > 0, F.concat(
            F.lit("dividend history incomplete (the vendor is missing payments in "), years, F.lit(")")))
    growth, source = derive_growth(F.col("__h"), DDM_GROWTH_CAP)
    d = d.withColumns({"__g": growth, "__src": source, "__r": discount_rate(F.col("risk_free_rate"), F.col("beta")),
                       "__incomplete": missing})
    bear, base, bull = growth_scenarios(F.col("__g"), DDM_GROWTH_CAP)
    r, ttm = F.col("__r"), F.col("__ttm")
    reasons = [(F.col("__years").isNull(), "no dividend history"),
               (F.col("__years") < 3, "insufficient dividend history (need >= 3 calendar years)"),
               (F.datediff(as_of, "__last") > DIVIDEND_STALE_DAYS, "dividends discontinued (no payment in the last 15 months)"),
               (F.col("__incomplete").isNotNull(), F.col("__incomplete")),
               (ttm <= 0, "no dividends in trailing 12 months")]
    applicable_fy = F.when((F.col("__years") >= 3) & (F.datediff(as_of, "__last") <= DIVIDEND_STALE_DAYS) & (ttm > 0)
                           & F.col("__incomplete").isNull(), F.year(as_of))
    return _result(d, "ddm", reasons, (ddm_per_share(ttm, bear, r + DISCOUNT_SPREAD), ddm_per_share(ttm, base, r),
                                       ddm_per_share(ttm, bull, r - DISCOUNT_SPREAD)), applicable_fy, None,
                   growth_base=F.col("__g"), growth_source=F.col("__src"), discount_base=r, basis=ttm)


# ---- all models, summary, verdicts

def run_valuations(inputs: DataFrame, dividends: DataFrame, as_of: Column, gaps: DataFrame | None = None) -> DataFrame:
    """The six models' rows, N/A rows kept."""
    frames = [value_dcf(inputs, as_of), value_ddm(inputs, dividends, as_of, gaps), value_graham(inputs, as_of),
              value_lynch(inputs, as_of), value_multiples(inputs, as_of), value_owner_earnings(inputs, as_of)]
    return reduce(lambda a, b: a.unionByName(b), frames)


def intrinsic_summary(results: DataFrame) -> DataFrame:
    """Medians over the applicable models of ``MEDIAN_MODELS`` (five rows per company at most)."""
    use = F.col("applicable") & F.col("model").isin(*MEDIAN_MODELS)
    g = results.groupBy("ticker").agg(
        F.sum(use.cast("int")).cast("int").alias("n_applicable"),
        *[array_median(F.collect_list(F.when(use, F.col(f"value_{n}")))).alias(f"median_{n}") for n in ("bear", "base", "bull")])
    return g


def verdict(bear: Column, bull: Column, price: Column) -> Column:
    known = bull.isNotNull() & (price > 0)
    return (F.when(known & bear.isNull(), F.when(price > bull, "expensive"))
            .when(known, F.when(price < bear, "cheap").when(price > bull, "expensive").otherwise("fair")))


def upside(value: Column, price: Column) -> Column:
    return F.when(price > 0, (value - price) / F.nullif(price, F.lit(0.0)))


def owner_verdict(value: Column, price: Column) -> Column:
    return F.when(value.isNotNull() & (price > 0), F.when(price < value * (1.0 - MARGIN_OF_SAFETY), "cheap")
                  .when(price > value, "expensive").otherwise("fair"))


def dcf_sensitivity(results: DataFrame, steps: tuple[float, ...] = (-0.02, -0.01, 0.0, 0.01, 0.02)) -> DataFrame:
    """DCF value on a grid of growth and discount around each company's base case (25 cells per company)."""
    d = results.where((F.col("model") == "dcf") & F.col("applicable"))
    grid = F.array(*[F.struct(F.lit(a).alias("dg"), F.lit(b).alias("dr")) for a in steps for b in steps])
    d = d.select("ticker", "basis", "shares_used", "growth_base", "discount_base", F.explode(grid).alias("s"))
    g, r = F.col("growth_base") + F.col("s.dg"), F.col("discount_base") + F.col("s.dr")
    return d.select("ticker", g.alias("growth"), r.alias("discount"),
                    F.when(r > TERMINAL_GROWTH, dcf_per_share(F.col("basis"), F.col("shares_used"), g, r)).alias("value"))


# ---- indicators

def implied_growth(fcf: Column, shares: Column, price: Column, discount: Column) -> Column:
    """The growth at which the DCF equals *price*: bisection until the bracket is under 1e-7 (24 halvings of 1.5)."""
    def halve(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2.0
        below = dcf_per_share(fcf, shares, mid, discount) < price
        done = acc["hi"] - acc["lo"] < REVERSE_TOLERANCE
        return F.struct(F.when(done | ~below, acc["lo"]).otherwise(mid).alias("lo"),
                        F.when(done | below, acc["hi"]).otherwise(mid).alias("hi"))

    start = F.struct(F.lit(REVERSE_LOW).alias("lo"), F.lit(REVERSE_HIGH).alias("hi"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(25)), start, halve)
    return (end["lo"] + end["hi"]) / 2.0


_IND = "ticker indicator applicable na_reason value_bear value_base value_bull basis_fiscal_year".split()


def _indicator(d: DataFrame, name: str, reasons: list[tuple[Column, Column | str]], values: tuple, fy: Column,
               as_of: Column | None = None) -> DataFrame:
    out = _result(d, name, reasons, tuple(v if v is not None else F.lit(None).cast("double") for v in values), fy, as_of)
    return out.withColumnRenamed("model", "indicator").select(*_IND)


def reverse_dcf(dcf: DataFrame, market: DataFrame, as_of: Column | None = None) -> DataFrame:
    """The growth the price implies on the DCF's own basis; *dcf*: ``value_dcf`` rows."""
    d = dcf.join(market.select("ticker", "current_price"), "ticker", "left")
    price, b, s, r = F.col("current_price"), F.col("basis"), F.col("shares_used"), F.col("discount_base")
    d = d.withColumns({"__low": dcf_per_share(b, s, F.lit(REVERSE_LOW), r), "__high": dcf_per_share(b, s, F.lit(REVERSE_HIGH), r)})
    reasons = [(~F.col("applicable"), F.concat(F.lit("no DCF: "), "na_reason")),
               (~(F.coalesce(price, F.lit(0.0)) > 0), "no price"),
               (F.col("__low") > price, "the price is below the DCF's value at -50% growth a year"),
               (F.col("__high") < price, "the price is above the DCF's value at 100% growth a year")]
    return _indicator(d, "reverse_dcf", reasons, (None, implied_growth(b, s, price, r), None), F.col("basis_fiscal_year"), as_of)


def _named_sector() -> Column:
    names = {"bank": "banks", "insurance": "insurers", "reit": "REITs"}
    named = F.coalesce(*[F.when(F.col("sector_class") == s, F.lit(n)) for s, n in names.items()],
                       F.concat(F.lit("sector '"), F.col("sector_class"), F.lit("'")))
    return F.concat(F.lit("does not apply to "), named)


def epv(annual_rows: DataFrame, market: DataFrame, wacc_of, total_debt: Column, as_of: Column | None = None) -> DataFrame:
    """Earnings power value: five-year mean EBIT margin on the latest revenue, taxed, over the WACC.

    *annual_rows*: ``scores.annual_rows``; *wacc_of*: builds the WACC column from market columns.
    """
    w = Window.partitionBy("ticker").orderBy("fiscal_year").rangeBetween(-(EPV_YEARS - 1), 0)
    income = F.coalesce(F.col("operating_income"), F.col("pretax_income") + zero_if_null(F.col("interest_expense")))
    margin = F.when(F.col("revenue") > 0, income / F.nullif(F.col("revenue"), F.lit(0.0)))
    d = annual_rows.withColumn("__margin", margin)
    d = d.withColumns({"__mean": F.avg("__margin").over(w), "__n": F.count("__margin").over(w),
                       "__last": F.max("fiscal_year").over(Window.partitionBy("ticker"))})
    filed = annual_rows.groupBy("ticker").agg(F.max_by("shares", F.when(F.col("shares") > 0, F.col("fiscal_year"))).alias("__filed"))
    d = d.where(F.col("fiscal_year") == F.col("__last")).join(market, "ticker", "left").join(filed, "ticker", "left")
    tax = F.coalesce(F.when(F.col("pretax_income") > 0, clamp(F.col("income_tax_expense") / F.nullif(F.col("pretax_income"), F.lit(0.0)), 0.0, 0.35)), F.lit(0.21))
    d = d.withColumns({"__adj": F.col("__mean") * F.col("revenue") * (1.0 - tax),
                       "__rate": wacc_of(F.col("market_cap"), F.col("risk_free_rate"), F.col("beta")),
                       "__sh": F.when(F.col("shares_outstanding") > 0, F.col("shares_outstanding")).otherwise(F.col("__filed"))})
    owed = zero_if_null(total_debt)
    cash = zero_if_null(F.col("cash_and_equivalents")) + zero_if_null(F.col("short_term_investments"))

    def at(rate: Column) -> Column:
        return F.when(rate > 0, (F.col("__adj") / F.nullif(rate, F.lit(0.0)) - owed + cash) / F.nullif(F.col("__sh"), F.lit(0.0)))

    reasons = [(~F.col("sector_class").isin(*DCF_SECTORS), _named_sector()),
               (F.col("debt_unknown"), "debt not on file though interest is paid"),
               (F.col("__n") < EPV_MIN_YEARS, f"operating income (or pretax income) and revenue in fewer than {EPV_MIN_YEARS} of the last {EPV_YEARS} fiscal years"),
               (~(F.coalesce(F.col("revenue"), F.lit(0.0)) > 0), "no revenue in the latest fiscal year"),
               (F.col("__adj") <= 0, "normalized after-tax operating earnings are not positive"),
               (F.col("__rate").isNull(), "no WACC: no market cap"),
               (~(F.coalesce(F.col("__sh"), F.lit(0.0)) > 0), "no share count")]
    fy = F.when(F.col("sector_class").isin(*DCF_SECTORS), F.col("fiscal_year"))
    return _indicator(d, "epv", reasons, (at(F.col("__rate") + EPV_WACC_SPREAD), at(F.col("__rate")), at(F.col("__rate") - EPV_WACC_SPREAD)), fy, as_of)


def ncav(latest: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Net current asset value per share; the bear case is net-net working capital where positive."""
    c = F.col
    value = (c("current_assets") - c("total_liabilities")) / F.nullif(c("shares"), F.lit(0.0))
    parts = (zero_if_null("cash_and_equivalents") + zero_if_null("short_term_investments")
             + NNWC_RECEIVABLES * zero_if_null("accounts_receivable") + NNWC_INVENTORY * zero_if_null("inventory"))
    nnwc = (parts - c("total_liabilities")) / F.nullif(c("shares"), F.lit(0.0))
    off = c("sector_class").isin("bank", "insurance")
    reasons = [(off, F.concat(_named_sector(), F.lit(" (no current assets)"))),
               (c("current_assets").isNull() | c("total_liabilities").isNull(), "no current assets or total liabilities"),
               (~(F.coalesce(c("shares"), F.lit(0.0)) > 0), "no share count"),
               (value <= 0, "net current assets are negative: total liabilities exceed current assets")]
    return _indicator(latest, "ncav", reasons, (F.when(nnwc > 0, nnwc), value, None), F.when(~off, c("fiscal_year")), as_of)


def ps_value(companies: DataFrame, ps_range: DataFrame) -> DataFrame:
    """The median P/S value, bear and bull scaled by the range's quartiles; *ps_range*: the P/S rows of ``ranges``."""
    d = companies.select("ticker", "sector_class").join(
        ps_range.select("ticker", F.col("applicable").alias("__ok"), F.col("na_reason").alias("__why"), "p25", "median", "p75",
                        "implied_value"), "ticker", "left")
    base, median = F.col("implied_value"), F.col("median")

    def scaled(q: str) -> Column:
        return F.when(median > 0, base * F.col(q) / F.nullif(median, F.lit(0.0)))

    reasons = [(F.col("__ok").isNull(), "no valuation history (run the backfill)"),
               (~F.col("__ok"), F.concat(F.lit("no P/S range: "), F.coalesce("__why", F.lit("not applicable")))),
               (base.isNull(), F.concat(F.lit("no current P/S value: "), F.coalesce("__why", F.lit("no trailing revenue"))))]
    return _indicator(d, "ps_value", reasons, (scaled("p25"), base, scaled("p75")), F.lit(None).cast("int"))


def graham_tangible(inputs: DataFrame, book: DataFrame, as_of: Column | None = None) -> DataFrame:
    """The Graham number on tangible book; *book*: ticker, fiscal_year, total_equity, goodwill, intangible_assets."""
    g = value_graham(inputs, as_of).select("ticker", "applicable", "na_reason", "value_bear", "value_base", "value_bull",
                                           F.col("basis_fiscal_year").alias("fiscal_year"))
    d = g.join(book, ["ticker", "fiscal_year"], "left")
    tangible = F.col("total_equity") - zero_if_null("goodwill") - zero_if_null("intangible_assets")
    # The Graham number scales with the square root of book value per share.
    share = F.when(tangible > 0, F.sqrt(tangible / F.nullif(F.col("total_equity"), F.lit(0.0))))
    reasons = [(~F.col("applicable"), F.coalesce("na_reason", F.lit("no Graham number"))),
               (~(F.coalesce(F.col("total_equity"), F.lit(0.0)) > 0), "no total equity"),
               (tangible <= 0, "tangible book is negative: goodwill and intangibles exceed equity")]
    return _indicator(d, "graham_tangible", reasons, tuple(F.col(f"value_{n}") * share for n in ("bear", "base", "bull")), F.col("fiscal_year"))
