"""Period logic on wide rows: trailing years, derived identities, calendar labels (RES-1, 2, 18, 19, 22, 26, 27)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finstrata.functions.exprs import col, sum_present

# The day spans of a full year and of a quarter, and the gap between quarter ends.
YEAR_DAYS = (350, 380)
QUARTER_DAYS = (80, 120)
# Fixed value: the equity tag that already holds the non-controlling interest.
EQUITY_WITH_NCI = "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"


def period_kind(start: Column | str, end: Column | str) -> Column:
    """instant, year, quarter or other, from a fact's dates."""
    start, end = col(start), col(end)
    days = F.datediff(end, start)
    return (F.when(start.isNull(), "instant").when(days.between(*YEAR_DAYS), "year")
            .when(days.between(*QUARTER_DAYS), "quarter").otherwise("other"))


def fiscal_year_of(end: Column | str) -> Column:
    """The year a period end belongs to: the first week of January closes the year before."""
    end = col(end)
    return F.year(end) - F.when((F.month(end) == 1) & (F.dayofmonth(end) <= 7), 1).otherwise(0)


def calendar_year_by_rule(end: Column | str) -> Column:
    """The calendar year most of a fiscal year falls in: that of the day 180 days before its end."""
    return F.year(F.date_sub(col(end), 180))


def calendar_quarter_by_rule(end: Column | str) -> Column:
    """The calendar quarter a period's middle (45 days before its end) falls in."""
    return F.quarter(F.date_sub(col(end), 45))


def calendar_from_frame(frame: Column | str) -> tuple[Column, Column]:
    """(year, quarter) read from a frame label such as CY2020, CY2020Q3 or CY2020Q3I."""
    text = col(frame)
    year = F.nullif(F.regexp_extract(text, r"^CY(\d{4})(?:Q([1-4]))?I?$", 1), F.lit(""))
    quarter = F.nullif(F.regexp_extract(text, r"^CY(\d{4})(?:Q([1-4]))?I?$", 2), F.lit(""))
    return year.cast("int"), quarter.cast("int")


def derive_identities(df: DataFrame, equity_tag: Column | None = None) -> DataFrame:
    """Fills a missing revenue, total liabilities, gross profit and discontinued cash flow from other items.

    A reported figure is never replaced; ``derived`` lists the items filled.
    """
    have = set(df.columns)

    def item(name: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast("double")

    interest_inside = (equity_tag == EQUITY_WITH_NCI) if equity_tag is not None else F.lit(False)
    minority = F.when(F.coalesce(interest_inside, F.lit(False)), 0.0).otherwise(
        F.coalesce(item("minority_interest"), F.lit(0.0)))
    revenue = F.coalesce(item("revenue"), item("net_interest_income") + item("noninterest_income"))
    rules = {
        "revenue": item("net_interest_income") + item("noninterest_income"),
        "total_liabilities": item("total_assets") - item("total_equity") - minority,
        "gross_profit": revenue - item("cost_of_revenue"),
        "cash_from_discontinued_operations": sum_present(
            item("discontinued_operating_cash_flow"), item("discontinued_investing_cash_flow"),
            item("discontinued_financing_cash_flow")),
    }
    filled = F.array_compact(F.array(*[
        F.when(item(k).isNull() & v.isNotNull(), F.lit(k)) for k, v in rules.items()]))
    kept = [F.col(c) for c in df.columns if c not in rules]
    return df.select(*kept, *[F.coalesce(item(k), v).alias(k) for k, v in rules.items()], filled.alias("derived"))


def _quarters_apart(earlier: Column, later: Column) -> Column:
    return F.datediff(later, earlier).between(*QUARTER_DAYS)


def drop_inside_quarter(quarterly: DataFrame, dollar_flows: Sequence[str]) -> DataFrame:
    """Drops period ends without any dollar flow lying between two consecutive quarters that have flows."""
    has_flow = F.coalesce(*[F.col(c).cast("double") for c in dollar_flows]).isNotNull()
    w = Window.partitionBy("ticker").orderBy("period_end")
    flow_end = F.when(has_flow, F.col("period_end"))
    before = F.last(flow_end, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(flow_end, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    inside = ~has_flow & F.coalesce(_quarters_apart(before, after), F.lit(False))
    return quarterly.withColumn("__inside", inside).where(~F.col("__inside")).drop("__inside")


def compute_ttm(quarterly: DataFrame, flows: Sequence[str], instants: Sequence[str] = (),
                averages: Sequence[str] = (), per_share: Sequence[str] = (),
                split_level: str | None = None) -> DataFrame:
    """Trailing four consecutive quarters: flows summed only when all four are present.

    Weighted counts are averaged and per-share figures summed, on the latest quarter's split level where
    *split_level* names a map column (field -> level). Instants are the latest quarter's.
    """
    w = Window.partitionBy("ticker").orderBy("period_end")
    four = w.rowsBetween(-3, 0)
    step = F.datediff(F.col("period_end"), F.lag("period_end").over(w)).between(*QUARTER_DAYS)
    marked = quarterly.withColumn("__step", step)
    three = w.rowsBetween(-2, 0)
    whole = (F.count("period_end").over(four) == 4) & (F.sum(F.col("__step").cast("int")).over(three) == 3)

    def total(name: str) -> Column:
        value = F.col(name)
        if split_level and (name in averages or name in per_share):
            level = F.coalesce(F.col(split_level)[name], F.lit(1.0))
            value = value / level if name in averages else value * level
            s = F.when(F.count(value).over(four) == 4, F.sum(value).over(four))
            s = s * level if name in averages else s / level
        else:
            s = F.when(F.count(value).over(four) == 4, F.sum(value).over(four))
        return s / 4.0 if name in averages else s

    labels = [c for c in ("fiscal_year", "fiscal_quarter", "calendar_year", "calendar_quarter")
              if c in quarterly.columns]
    return (marked.select("ticker", "period_end", *labels, whole.alias("__whole"),
                          *[total(c).alias(c) for c in [*flows, *averages, *per_share]],
                          *[F.col(c) for c in instants])
            .where(F.col("__whole")).drop("__whole"))


def ended_years(annual: DataFrame, facts: DataFrame) -> DataFrame:
    """Drops fiscal years that had not ended by the latest day any of the company's facts was filed."""
    latest = facts.groupBy("ticker").agg(F.max("filed").alias("__filed"))
    return (annual.join(latest, "ticker", "left")
            .where(F.col("__filed").isNull() | (F.col("period_end") <= F.col("__filed"))).drop("__filed"))
