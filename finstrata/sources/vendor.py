"""Landed vendor records to tables: company info, officers, valuation fields, holder statistics, holders, earnings quarters.

A record is (ticker, collected_at, info) with *info* as JSON text; lists are JSON inside it or columns beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Our column, its type, and the vendor's names for it, first present first.
COMPANY = """
name string longName shortName
symbol string symbol
exchange string exchange
currency string currency
sector string sector
industry string industry
description string longBusinessSummary
website string website
country string country
city string city
state string state
address string address1
zip string zip
phone string phone
full_time_employees bigint fullTimeEmployees
"""
VALUATION = """
pe_trailing double trailingPE
pe_forward double forwardPE
peg_ratio double pegRatio
eps_trailing double trailingEps
eps_forward double forwardEps
price_to_book double priceToBook
price_to_sales double priceToSalesTrailing12Months
enterprise_value double enterpriseValue
ev_to_revenue double enterpriseToRevenue
ev_to_ebitda double enterpriseToEbitda
profit_margin double profitMargins
operating_margin double operatingMargins
gross_margin double grossMargins
ebitda_margin double ebitdaMargins
return_on_assets double returnOnAssets
return_on_equity double returnOnEquity
revenue_growth double revenueGrowth
earnings_growth double earningsGrowth
dividend_rate double dividendRate
dividend_yield percent dividendYield
payout_ratio double payoutRatio
ex_dividend_date epoch exDividendDate
book_value double bookValue
total_revenue double totalRevenue
revenue_per_share double revenuePerShare
ebitda double ebitda
net_income double netIncomeToCommon
free_cash_flow double freeCashflow
operating_cash_flow double operatingCashflow
total_cash double totalCash
total_debt double totalDebt
debt_to_equity double debtToEquity
current_ratio double currentRatio
quick_ratio double quickRatio
"""
HOLDER_STATS = """
shares_outstanding double sharesOutstanding
float_shares double floatShares
shares_short double sharesShort
shares_short_prior_month double sharesShortPriorMonth
short_ratio double shortRatio
short_percent_of_float double shortPercentOfFloat
insider_percent double heldPercentInsiders
institutional_percent double heldPercentInstitutions
"""
OFFICERS = "array<struct<name:string,title:string,age:int,totalPay:double>>"
EARNINGS = """
eps_estimate double epsEstimate EPS_Estimate estimate
eps_actual double epsActual Reported_EPS actual
surprise_pct double surprisePercent Surprise surprise
"""
HOLDER = "array<map<string,string>>"


def _typed(raw: Column, kind: str) -> Column:
    if kind == "epoch":
        return F.to_date(F.timestamp_seconds(raw.try_cast("bigint")))
    if kind == "percent":
        return raw.try_cast("double") / 100
    number = raw.try_cast(kind)
    return F.when(~F.isnan(number), number) if kind == "double" else number


def _columns(fields: str, source: Column) -> list[Column]:
    out = []
    for line in fields.strip().splitlines():
        name, kind, *alternatives = line.split()
        out.append(F.coalesce(*[_typed(F.try_element_at(source, F.lit(a)), kind) for a in alternatives]).alias(name))
    return out


def _with_map(records: DataFrame) -> DataFrame:
    return records.withColumn("__m", F.from_json("info", "map<string,string>"))


def read_vendor_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON-lines file whose ``info`` is kept as text."""
    raw = spark.read.text(path)
    field = lambda k: F.get_json_object("value", f"$.{k}")
    return raw.select(field("ticker").alias("ticker"), field("collected_at").try_cast("timestamp").alias("collected_at"), *[field(k).alias(k) for k in ("info", "institutional_holders", "mutualfund_holders", "earnings")])


def company_info(records: DataFrame) -> DataFrame:
    return _with_map(records).select("ticker", "collected_at", *_columns(COMPANY, F.col("__m")))


def officers(records: DataFrame) -> DataFrame:
    """(ticker, place, name, title, age, total_pay), in the record's order."""
    o = records.select("ticker", F.posexplode(F.from_json(F.get_json_object("info", "$.companyOfficers"), OFFICERS)).alias("place", "o"))
    return o.select("ticker", "place", "o.name", "o.title", "o.age", F.col("o.totalPay").alias("total_pay"))


def valuation_fields(records: DataFrame) -> DataFrame:
    """Ratios and totals; a yield in percent becomes a fraction, a day in seconds a date; what is no number is NULL."""
    return _with_map(records).select("ticker", "collected_at", *_columns(VALUATION, F.col("__m")))


def holder_stats(records: DataFrame) -> DataFrame:
    return _with_map(records).select("ticker", "collected_at", *_columns(HOLDER_STATS, F.col("__m")))


def holders(records: DataFrame) -> DataFrame:
    """(ticker, kind, holder, shares, value, percent, reported) of the institutional and fund lists."""
    long = records.unpivot(["ticker"], ["institutional_holders", "mutualfund_holders"], "kind", "json")
    h = long.select("ticker", F.regexp_replace("kind", "_holders$", "").alias("kind"), F.explode(F.from_json("json", HOLDER)).alias("m"))
    at = lambda *names: F.coalesce(*[F.try_element_at("m", F.lit(n)) for n in names])
    return h.select("ticker", "kind", at("Holder", "holder").alias("holder"), at("Shares", "shares").try_cast("double").alias("shares"), at("Value", "value").try_cast("double").alias("value"),
                    at("pctHeld", "% Out").try_cast("double").alias("percent"), F.to_date(F.substring(at("Date Reported", "date"), 1, 10)).alias("reported"))


def earnings_quarters(records: DataFrame) -> DataFrame:
    """(ticker, quarter, eps_estimate, eps_actual, surprise_pct); rows without a quarter are left out."""
    e = records.select("ticker", F.explode(F.from_json("earnings", HOLDER)).alias("m"))
    quarter = F.substring(F.try_element_at("m", F.lit("quarter")), 1, 10).try_cast("date")
    return e.select("ticker", quarter.alias("quarter"), *_columns(EARNINGS, F.col("m"))).where(F.col("quarter").isNotNull())
