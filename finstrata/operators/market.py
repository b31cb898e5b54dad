"""Market-level views over long (series, date, value) rows (MKT-1..9).

A series has at most one value a day, so a window over one series is bounded by the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finstrata.functions.exprs import array_median

# Fixed values of the views.
ZONES = ("significantly undervalued", "modestly undervalued", "fairly valued", "modestly overvalued",
         "significantly overvalued")
ZONE_CUTOFFS = (-2.0, -1.0, 1.0, 2.0)
PILLS = {"significantly undervalued": "cheap", "modestly undervalued": "cheap", "fairly valued": "fair",
         "modestly overvalued": "expensive", "significantly overvalued": "expensive"}
MIN_TREND_QUARTERS, MILLIONS_PER_BILLION, MIN_MONTHS = 3, 1000.0, 36
YEAR_AGO_DAYS, SPREAD_DECIMALS, EPISODE_GAP, EPISODE_MIN_DAYS = 365, 6, 20, 20
SPREADS = (("10y", "2y"), ("10y", "3m"))
MATURITIES = "1m 6w 2m 3m 4m 6m 1y 2y 3y 5y 7y 10y 20y 30y".split()


def pick(series: DataFrame, name: str, out: str = "value") -> DataFrame:
    return series.where(F.col("series") == name).select("date", F.col("value").alias(out))


def decimal_year(d: Column | str) -> Column:
    """A date as a year with months as twelfths and days as a share of their month."""
    d = F.col(d) if isinstance(d, str) else d
    return F.year(d) + (F.month(d) - 1 + (F.dayofmonth(d) - 1) / F.dayofmonth(F.last_day(d))) / 12.0


def buffett_series(series: DataFrame, equities: str = "fred:NCBEILQ027S", gdp: str = "fred:GDP") -> DataFrame:
    """Equities over GDP in percent on common quarters, with the log-linear trend and its one- and two-sd bands."""
    j = (pick(series, equities, "e").join(pick(series, gdp, "g"), "date").where((F.col("e") > 0) & (F.col("g") > 0))
         .select("date", (F.col("e") / MILLIONS_PER_BILLION / F.col("g") * 100).alias("ratio")))
    j = j.withColumns({"__t": decimal_year("date"), "__y": F.ln("ratio")})
    fit = j.agg(F.regr_slope("__y", "__t").alias("__slope"), F.avg("__t").alias("__mt"), F.avg("__y").alias("__my"),
                F.count("*").alias("quarters"))
    # One row of totals beside the quarters of two series: bounded by the calendar, so the broadcast is tiny.
    f = j.crossJoin(F.broadcast(fit)).withColumn("__fit", F.col("__my") + F.col("__slope") * (F.col("__t") - F.col("__mt")))
    sd = f.agg(F.stddev_samp(F.col("__y") - F.col("__fit")).alias("sd"))
    f = f.crossJoin(F.broadcast(sd)).where(F.col("quarters") >= MIN_TREND_QUARTERS)
    trend = F.exp("__fit")
    return f.select("date", "ratio", trend.alias("trend"), (F.exp("__slope") - 1).alias("growth"), "sd", "quarters",
                    ((F.col("__y") - F.col("__fit")) / F.nullif(F.col("sd"), F.lit(0.0))).alias("z"),
                    *[(trend * F.exp(F.lit(float(k)) * F.col("sd"))).alias(n) for n, k in
                      (("lower_2sd", -2), ("lower_1sd", -1), ("upper_1sd", 1), ("upper_2sd", 2))])


def zone(z: Column) -> Column:
    a, b, c, d = ZONE_CUTOFFS
    return (F.when(z < a, ZONES[0]).when(z < b, ZONES[1]).when(z <= c, ZONES[2]).when(z <= d, ZONES[3])
            .when(z.isNotNull(), ZONES[4]))


def _share_at_or_below(value: Column, latest: Column) -> Column:
    return F.sum((value <= latest).cast("int")) / F.count(value)


def buffett(series: DataFrame, equities: str = "fred:NCBEILQ027S", gdp: str = "fred:GDP") -> DataFrame:
    """The latest quarter of the indicator: ratio, trend, growth, z, zone, pill and percentile."""
    q = buffett_series(series, equities, gdp)
    last = q.agg(F.max_by(F.struct("date", "ratio", "trend", "growth", "sd", "z", "quarters"), "date").alias("l"),
                 F.min("date").alias("first_date"), F.collect_list("ratio").alias("__all"))
    rank = F.size(F.filter("__all", lambda v: v <= F.col("l.ratio"))) / F.size("__all")
    zz = zone(F.col("l.z"))
    pill = F.coalesce(*[F.when(zz == k, F.lit(p)) for k, p in PILLS.items()])
    return last.where(F.col("l.date").isNotNull()).select("l.*", "first_date", zz.alias("zone"), pill.alias("pill"),
                                                          F.when(F.size("__all") >= MIN_MONTHS, rank).alias("percentile"))


def cape(series: DataFrame, name: str = "shiller:cape") -> DataFrame:
    """The latest CAPE against its history; the statistics need 36 months."""
    p = pick(series, name)
    g = p.agg(F.max("date").alias("date"), F.max_by("value", "date").alias("value"), F.min("date").alias("first_date"),
              F.count("*").alias("months"), F.avg("value").alias("mean"), F.min("value").alias("min"),
              F.max("value").alias("max"), F.min_by("date", F.struct("value", "date")).alias("min_date"),
              F.max_by("date", F.struct("value", -F.unix_date("date"))).alias("max_date"),
              F.collect_list("value").alias("__v"))
    enough = F.col("months") >= MIN_MONTHS
    stats = {c: F.col(c) for c in ("mean", "min", "max", "min_date", "max_date")}
    stats["median"] = array_median(F.col("__v"))
    stats["percentile"] = F.size(F.filter("__v", lambda v: v <= F.col("value"))) / F.col("months")
    return g.where(F.col("date").isNotNull()).select("date", "value", "first_date", "months",
                                                     *[F.when(enough, c).alias(n) for n, c in stats.items()])


def cape_recomputed(series: DataFrame, price: str = "shiller:real_price", earnings: str = "shiller:real_earnings",
                    months: int = 120) -> DataFrame:
    """Real price over the mean real earnings of the prior *months*."""
    j = pick(series, price, "price").join(pick(series, earnings, "earnings"), "date", "left")
    idx = F.year("date") * 12 + F.month("date")
    # One row a month: a few thousand at most, so one ordered window is bounded.
    w = Window.partitionBy(F.lit(0)).orderBy(idx).rangeBetween(-months, -1)
    return (j.withColumns({"mean_earnings": F.avg("earnings").over(w), "__n": F.count("price").over(w)})
            .where(F.col("__n") == months)
            .select("date", "price", "mean_earnings", (F.col("price") / F.nullif(F.col("mean_earnings"), F.lit(0.0))).alias("cape")))


def _maturity() -> Column:
    return F.regexp_extract("series", r"^ust:(.+)$", 1)


def yield_curve(series: DataFrame, year_ago_days: int = YEAR_AGO_DAYS) -> DataFrame:
    """The curve of the latest day any maturity has, and of the latest day at least *year_ago_days* before."""
    y = series.where(F.col("series").startswith("ust:")).select("date", _maturity().alias("maturity"), "value")
    latest = y.agg(F.max("date").alias("__latest"))
    back = y.crossJoin(F.broadcast(latest)).where(F.col("date") <= F.date_sub("__latest", year_ago_days))
    ago = back.agg(F.max("date").alias("__ago"))
    j = y.crossJoin(F.broadcast(latest)).crossJoin(F.broadcast(ago))
    which = F.when(F.col("date") == F.col("__latest"), "latest").when(F.col("date") == F.col("__ago"), "year_ago")
    order = F.array_position(F.array(*[F.lit(m) for m in MATURITIES]), F.col("maturity")).cast("int")
    return (j.withColumn("curve", which).where(F.col("curve").isNotNull())
            .select("curve", "date", "maturity", order.alias("position"), "value"))


def spreads(series: DataFrame, pairs: tuple[tuple[str, str], ...] = SPREADS) -> DataFrame:
    """Each spread on the days both maturities have: (spread, date, value, inverted)."""
    out = None
    for long, short in pairs:
        j = (pick(series, f"ust:{long}", "l").join(pick(series, f"ust:{short}", "s"), "date")
             .select(F.lit(f"{long}_{short}").alias("spread"), "date",
                     F.round(F.col("l") - F.col("s"), SPREAD_DECIMALS).alias("value")))
        out = j if out is None else out.unionByName(j)
    return out.withColumn("inverted", F.col("value") < 0)


def spread_summary(daily: DataFrame) -> DataFrame:
    return daily.groupBy("spread").agg(
        F.count("*").alias("days"), F.min("date").alias("first_date"), F.max("date").alias("latest_date"),
        F.max_by("value", "date").alias("latest_value"), F.max_by("inverted", "date").alias("inverted"),
        F.avg(F.col("inverted").cast("int")).alias("inverted_share"),
        F.max(F.when(F.col("inverted"), F.col("date"))).alias("last_inverted_day"))


def episodes(daily: DataFrame, gap: int = EPISODE_GAP, min_days: int = EPISODE_MIN_DAYS) -> DataFrame:
    """The inversion episodes: inverted days joined across gaps of at most *gap* of the spread's days."""
    w = Window.partitionBy("spread").orderBy("date")
    inv = daily.withColumn("__i", F.row_number().over(w)).where("inverted")
    inv = inv.withColumn("__new", F.coalesce(F.col("__i") - F.lag("__i").over(w) - 1 > gap, F.lit(True)).cast("int"))
    inv = inv.withColumn("__e", F.sum("__new").over(w))
    return (inv.groupBy("spread", "__e").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("days"))
            .where(F.col("days") >= min_days).drop("__e"))


def latest_episode(daily: DataFrame, gap: int = EPISODE_GAP, min_days: int = EPISODE_MIN_DAYS) -> DataFrame:
    return (episodes(daily, gap, min_days).groupBy("spread")
            .agg(F.max_by(F.struct("first", "last", "days"), "last").alias("e")).select("spread", "e.*"))


def market_view(series: DataFrame, fetches: DataFrame, equities: str, gdp: str) -> DataFrame:
    """One row per section: whether it has figures, its date, why not, and its sources' last fetch."""
    b = buffett(series, equities, gdp).select(F.lit("buffett").alias("section"), "date")
    c = cape(series).select(F.lit("cape").alias("section"), "date")
    y = series.where(F.col("series").startswith("ust:")).agg(F.max("date").alias("date")).select(F.lit("yield_curve").alias("section"), "date")
    spark = series.sparkSession
    reasons = {"buffett": "the two quarterly series are not stored or share too few quarters",
               "cape": "the cyclically adjusted P/E is not stored", "yield_curve": "the yield curve is not stored"}
    names = spark.createDataFrame([(k, v) for k, v in reasons.items()], "section string, why string")
    got = b.unionByName(c).unionByName(y)
    last = fetches.groupBy("section").agg(F.max("fetched_at").alias("fetched_at"))
    return (names.join(got, "section", "left").join(last, "section", "left")
            .select("section", F.col("date").isNotNull().alias("available"), "date",
                    F.when(F.col("date").isNull(), F.col("why")).alias("reason"), "fetched_at"))


def risk_free(series: DataFrame, maturity: str = "10y", estimate: float | None = None) -> DataFrame:
    """The latest non-missing rate of a maturity as a fraction: first source present wins, else the estimate."""
    order = F.when(F.col("series") == f"fred:{maturity}", 0).when(F.col("series") == f"ust:{maturity}", 1)
    s = series.withColumn("__o", order).where(F.col("__o").isNotNull() & F.col("value").isNotNull())
    per = s.groupBy("__o").agg(F.max_by("value", "date").alias("v"), F.max("date").alias("d"))
    got = per.agg(F.min_by(F.struct("v", "d", "__o"), "__o").alias("b"))
    fallback = F.lit(None).cast("double") if estimate is None else F.lit(float(estimate))
    source = F.when(F.col("b.__o") == 0, "fred").when(F.col("b.__o") == 1, "treasury_gov").when(fallback.isNotNull(), "estimate")
    return got.select(F.coalesce(F.col("b.v") / 100, fallback).alias("rate"), F.col("b.d").alias("date"), source.alias("source"))


def series_summary(series: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    s = series
    if start:
        s = s.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        s = s.where(F.col("date") <= F.lit(end).cast("date"))
    return s.groupBy("series").agg(F.count("*").alias("rows"), F.min("date").alias("first"), F.max("date").alias("last"),
                                   F.max_by("value", "date").alias("latest"))
