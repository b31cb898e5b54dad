"""Share splits and per-share bases (SPL-1, 2, 3, 5..11, 13, 15)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finstrata.functions.exprs import array_median
from finstrata.functions.scale import asof_lookup

# How close to a simple fraction a ratio must be, and the thresholds of the rules below.
SIMPLE_TOLERANCE, MAX_DENOMINATOR = 1e-9, 4
SPLIT_JUMP, SHARE_CLASS_GAP, MIN_SHARE_COUNT_RATIO = 1.5, 1.02, 0.75
SPIN_OFF_MULTIPLE, SPIN_OFF_DAYS, MIN_EPS_FOR_COUNT = 5.0, 400, 0.10
SHARE_FIELDS = ("weighted_avg_shares_basic", "shares_outstanding", "weighted_avg_shares_diluted")
COVERAGE, COVERAGE_QUARTERS = 0.6, 40


def is_simple_ratio(ratio: Column) -> Column:
    """Whether *ratio* or its inverse is a fraction with a denominator of at most four."""
    inverse = F.lit(1.0) / F.nullif(ratio, F.lit(0.0))
    near = [F.abs(F.round(x * float(d)) / float(d) - x) <= SIMPLE_TOLERANCE * x
            for x in (ratio, inverse) for d in range(1, MAX_DENOMINATOR + 1)]
    return F.coalesce((ratio > 0) & reduce(lambda a, b: a | b, near), F.lit(False))


def is_share_split(ratio: Column) -> Column:
    """A split proper rather than a spin-off's price factor or a stock dividend: a simple ratio other than 1."""
    return is_simple_ratio(ratio) & (F.abs(ratio - 1.0) >= 1e-9)


def is_restating_split(ratio: Column) -> Column:
    """A split filings restate for: a simple ratio of 3:2 or more, or 2:3 or less."""
    return is_simple_ratio(ratio) & ((ratio >= SPLIT_JUMP) | (ratio <= 1.0 / SPLIT_JUMP))


def split_product(probes: DataFrame, splits: DataFrame, key: str = "ticker", shares_only: bool = False) -> DataFrame:
    """Adds ``factor``: the product of the ratios dated in (after, through]; 1.0 without any.

    *probes* are distinct (key, after, through); a company has few splits, so each probe meets few.
    """
    s = splits.where(F.col("ratio") > 0)
    if shares_only:
        s = s.where(is_share_split(F.col("ratio")))
    s = s.select(F.col(key).alias("__k"), F.col("date").alias("__d"), "ratio")
    j = probes.join(s, (F.col(key) == F.col("__k")) & (F.col("__d") > F.col("after")) & (F.col("__d") <= F.col("through")), "left")
    return j.groupBy(*probes.columns).agg(F.coalesce(F.product("ratio"), F.lit(1.0)).alias("factor"))


def restated_between(probes: DataFrame, splits: DataFrame) -> DataFrame:
    """Adds ``factor`` that moves a figure filed on ``from_day`` to the basis of ``to_day`` (either may be the later)."""
    forward = F.col("from_day") <= F.col("to_day")
    p = probes.select("*", F.least("from_day", "to_day").alias("after"), F.greatest("from_day", "to_day").alias("through"))
    f = split_product(p, splits.where(is_restating_split(F.col("ratio"))), "ticker")
    return f.withColumn("factor", F.when(forward, F.col("factor")).otherwise(1.0 / F.col("factor"))).drop("after", "through")


def apply_later_splits(latest: DataFrame, splits: DataFrame, through: str = "priced_on") -> DataFrame:
    """Puts each company's latest filed per-share figures onto the price's basis: splits after the filing, to *through*."""
    p = latest.select("ticker", F.col("filed_date").alias("after"), F.col(through).alias("through")).distinct()
    f = split_product(p, splits, "ticker", shares_only=True)
    j = latest.join(f.select("ticker", F.col("after").alias("filed_date"), F.col("through").alias(through), "factor"), ["ticker", "filed_date", through], "left")
    c = F.coalesce("factor", F.lit(1.0))
    return j.withColumns({"eps": F.col("eps") / c, "shares": F.col("shares") * c}).drop("factor")


def undo_splits_after_price(figures: DataFrame, splits: DataFrame) -> DataFrame:
    """Takes the splits between the price's day and the latest filing back out of figures restated for them."""
    p = figures.select("ticker", F.col("priced_on").alias("after"), F.col("filed_date").alias("through")).distinct()
    s = splits.where(is_restating_split(F.col("ratio")) & F.col("ratio").between(1 / 50.0, 50.0))
    f = split_product(p, s).select("ticker", F.col("after").alias("priced_on"), F.col("through").alias("filed_date"), "factor")
    c = F.coalesce("factor", F.lit(1.0))
    return (figures.join(f, ["ticker", "priced_on", "filed_date"], "left")
            .withColumns({"eps": F.col("eps") * c, "shares": F.col("shares") / c}).drop("factor"))


def ads_ratio(filed_to_market: Column) -> Column:
    """Filed shares per depositary share (or its inverse): 1, a whole number of at least two, else unreadable."""
    r = filed_to_market
    inverse = F.lit(1.0) / F.nullif(r, F.lit(0.0))

    def whole(x: Column) -> Column:
        n = F.round(x)
        return F.when((n >= 2) & (F.abs(x - n) <= F.least(0.05 * n, F.lit(0.25))), n)

    return F.when(r.between(0.8, 1.25), 1.0).otherwise(F.coalesce(whole(r), 1.0 / whole(inverse)))


def dividends_onto(dividends: DataFrame, splits: DataFrame, onto: Column) -> DataFrame:
    """Payments moved from the split basis of the day they were served to that of *onto*; without a served day a
    payment is on the basis of every split."""
    d = dividends.withColumn("__to", onto)
    p = d.select("ticker", "served_on", "__to").distinct()
    s = splits.where(F.col("ratio") > 0).select("ticker", F.col("date").alias("__d"), "ratio")
    up = (F.col("__to") < F.col("__d")) & (F.col("served_on").isNull() | (F.col("__d") <= F.col("served_on")))
    down = (F.col("served_on") < F.col("__d")) & (F.col("__d") <= F.col("__to"))
    f = (p.join(s, "ticker").where(up | F.coalesce(down, F.lit(False)))
         .groupBy("ticker", "served_on", "__to").agg(F.product(F.when(up, F.col("ratio")).otherwise(1.0 / F.col("ratio"))).alias("__f")))
    k = f.select(F.col("ticker").alias("__k"), F.col("served_on").alias("__s"), F.col("__to").alias("__t"), "__f")
    cond = (F.col("ticker") == F.col("__k")) & F.col("served_on").eqNullSafe(F.col("__s")) & (F.col("__to") == F.col("__t"))
    return (d.join(k, cond, "left").withColumn("amount", F.col("amount") * F.coalesce("__f", F.lit(1.0)))
            .drop("__f", "__to", "__k", "__s", "__t"))


def drop_spin_offs(dividends: DataFrame, splits: DataFrame) -> DataFrame:
    """Drops a payment on the day of a price factor (between 2:3 and 3:2) over five times the median of those around.

    One payment a day, so the frame of 400 days around a payment is bounded.
    """
    w = Window.partitionBy("ticker").orderBy(F.unix_date("date"))
    around = F.concat(F.collect_list("amount").over(w.rangeBetween(-SPIN_OFF_DAYS, -1)),
                      F.collect_list("amount").over(w.rangeBetween(1, SPIN_OFF_DAYS)))
    r = F.col("ratio")
    days = splits.where((r != 1.0) & (r > 1.0 / SPLIT_JUMP) & (r < SPLIT_JUMP)).select("ticker", "date").distinct().withColumn("__f", F.lit(True))
    j = dividends.withColumn("__usual", array_median(around)).join(days, ["ticker", "date"], "left")
    spin = F.coalesce(F.col("__f") & (F.col("amount") > SPIN_OFF_MULTIPLE * F.col("__usual")), F.lit(False))
    return j.where(~spin).drop("__usual", "__f")


def dividend_factors(dividends: DataFrame, bars: DataFrame) -> DataFrame:
    """Adds ``factor``: how the payment scales the closes before it, f = 1 / (1 + d * later / close).

    ``later`` is the product of the factors of later payments, ``close`` the last close before the payment; a
    company's payments are one a day, folded newest first.
    """
    p = dividends.withColumn("__eve", F.date_sub("date", 1))
    c = asof_lookup(p, bars.where(F.col("close") > 0).select("ticker", F.col("date").alias("bar_date"), "close"), ["ticker"], "__eve", "bar_date", ["close"])
    packed = c.where(F.col("close") > 0).groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("date", "amount", "close")), asc=False).alias("s"))
    one = "array<struct<date:date,amount:double,factor:double>>"
    def fold(acc: Column, x: Column) -> Column:
        f = F.lit(1.0) / (F.lit(1.0) + x["amount"] * acc["later"] / x["close"])
        return F.struct((acc["later"] * f).alias("later"), F.concat(acc["out"], F.array(F.struct(
            x["date"].alias("date"), x["amount"].alias("amount"), f.alias("factor")))).alias("out"))

    folded = F.aggregate("s", F.struct(F.lit(1.0).alias("later"), F.array().cast(one).alias("out")), fold)
    return packed.select("ticker", F.explode(folded["out"]).alias("d")).select("ticker", "d.*")


def bars_to_price(splits: DataFrame, snapshots: DataFrame, bars: DataFrame) -> DataFrame:
    """(ticker, factor): puts a bar's close on the latest snapshot price's basis, by splits between the two days."""
    last = bars.groupBy("ticker").agg(F.max("date").alias("last_bar"))
    priced = snapshots.where(F.col("current_price").isNotNull()).groupBy("ticker").agg(F.to_date(F.max("collected_at")).alias("priced_on"))
    p = last.join(priced, "ticker").select("ticker", F.least("last_bar", "priced_on").alias("after"), F.greatest("last_bar", "priced_on").alias("through"),
                                            (F.col("last_bar") > F.col("priced_on")).alias("__back"))
    f = split_product(p, splits, "ticker")
    return f.select("ticker", F.when(F.col("__back"), F.col("factor")).otherwise(1.0 / F.col("factor")).alias("factor"))


def total_shares(market_cap: Column, price: Column, vendor: Column, latest: Column) -> tuple[Column, Column]:
    """(shares of every class, source): the vendor's count unless market cap over price shows more classes; the
    latest fiscal year's where either falls well short of it."""
    vendor, latest = F.when(vendor != 0, vendor), F.when(latest > 0, latest)
    by_value = F.when((market_cap != 0) & (price != 0), market_cap / F.nullif(price, F.lit(0.0)))
    wider = by_value.isNotNull() & (vendor.isNull() | (by_value > SHARE_CLASS_GAP * vendor))
    count = F.when(wider, by_value).otherwise(vendor)
    short = F.coalesce(count < MIN_SHARE_COUNT_RATIO * latest, F.lit(False))
    source = F.when(short, "financials_annual").when(wider, "market_cap / price").otherwise("market_snapshot")
    return F.when(short, latest).otherwise(count), source


def pick_share_field(quarterly: DataFrame, fields: tuple[str, ...] = SHARE_FIELDS) -> DataFrame:
    """(ticker, share_field): the first field covering 60 % of the company's latest 40 quarters, else net income / EPS."""
    w = Window.partitionBy("ticker").orderBy(F.desc("period_end"))
    q = quarterly.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= COVERAGE_QUARTERS)
    have = [f for f in fields if f in quarterly.columns]
    implied = F.col("net_income").isNotNull() & (F.abs(F.col("eps_diluted")) >= MIN_EPS_FOR_COUNT)
    g = q.groupBy("ticker").agg(*[F.avg(F.coalesce(F.col(f) > 0, F.lit(False)).cast("int")).alias(f"__{f}") for f in have],
                                F.avg(F.coalesce(implied, F.lit(False)).cast("int")).alias("__implied"))
    pick = F.coalesce(*[F.when(F.col(f"__{f}") >= COVERAGE - 1e-9, F.lit(f)) for f in have],
                      F.when(F.col("__implied") >= COVERAGE - 1e-9, F.lit("net_income/eps_diluted")))
    return g.select("ticker", pick.alias("share_field"))


def factors_since(splits: DataFrame, snapshots: DataFrame, runs: DataFrame) -> DataFrame:
    """Splits and factors a company's stored price or last run has not seen: dated after either day."""
    priced = snapshots.groupBy("ticker").agg(F.to_date(F.max("collected_at")).alias("priced_on"))
    seen = runs.groupBy("ticker").agg(F.to_date(F.max("collected_at")).alias("since"))
    j = splits.join(priced, "ticker", "left").join(seen, "ticker", "left")
    return j.where((F.col("date") > F.col("priced_on")) | (F.col("date") > F.col("since"))).select(
        "ticker", "date", "ratio", is_share_split(F.col("ratio")).alias("share_split"))
