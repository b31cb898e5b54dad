"""SRC-11: vendor records of the stand-in's companies, landed as JSON lines and read back."""

from pyspark.sql import functions as F

from finstrata.plans.catalog._core import query
from finstrata.plans.catalog.j_store import landed
from finstrata.sources import vendor


def records(u):
    """One record a snapshot: names and ratios in ``info``, odd companies with a short name only; holders and quarters from the snapshot."""
    s = u.snapshots.join(u.company.select("ticker", "company_name", "sic"), "ticker").withColumn("n", F.substring("ticker", 2, 9).cast("int"))
    info = F.to_json(F.struct(F.when(F.col("n") % 2 == 0, F.concat(F.col("company_name"), F.lit(" Inc"))).alias("longName"), F.col("company_name").alias("shortName"), F.col("sic").alias("industry"),
                              F.col("current_price").alias("trailingPE"), F.lit("n/a").alias("forwardPE"), F.col("beta").alias("dividendYield"), (F.unix_timestamp("collected_at")).alias("exDividendDate"),
                              F.col("market_cap").alias("sharesOutstanding"), F.array(F.struct(F.lit("A").alias("name"), F.lit("CEO").alias("title"), F.col("n").alias("age")), F.struct(F.lit("B").alias("name"), F.lit("CFO").alias("title"), F.lit(None).cast("int").alias("age"))).alias("companyOfficers")))
    holder = F.array(F.struct(F.col("company_name").alias("Holder"), F.col("market_cap").alias("Shares"), F.col("current_price").alias("Value"), F.date_format("collected_at", "yyyy-MM-dd").alias("Date Reported")))
    quarter = F.array(F.struct(F.date_format("collected_at", "yyyy-MM-dd").alias("quarter"), F.col("current_price").alias("EPS_Estimate"), F.col("beta").alias("epsActual")), F.struct(F.lit(None).cast("string").alias("quarter"), F.lit(1.0).alias("EPS_Estimate"), F.lit(2.0).alias("epsActual")))
    line = F.to_json(F.struct("ticker", F.date_format("collected_at", "yyyy-MM-dd HH:mm:ss").alias("collected_at"), info.alias("info"), F.to_json(holder).alias("institutional_holders"), F.to_json(quarter).alias("earnings")))
    # Compressed files can't be split, so a file holds a bounded number of records.
    return vendor.read_vendor_records(u.spark, landed(u, "vendor_info", lambda p: s.select(line.alias("value")).write.option("maxRecordsPerFile", 50_000).text(p, compression="gzip")))


_S = "FROM si_snapshots s JOIN (SELECT ticker, company_name, sic, CAST(substr(ticker, 2) AS INT) AS n FROM si_company) c ON c.ticker = s.ticker"


@query("src11_company_info", f"SELECT s.ticker, collected_at, CASE WHEN n % 2 = 0 THEN company_name || ' Inc' ELSE company_name END AS name, sic AS industry, CAST(NULL AS VARCHAR) AS country {_S}")
def company(u):
    return vendor.company_info(records(u)).select("ticker", "collected_at", "name", "industry", "country")


@query("src11_officers", f"SELECT s.ticker, unnest([0, 1]) AS place, unnest(['A', 'B']) AS name, unnest(['CEO', 'CFO']) AS title, unnest([n, NULL]) AS age {_S}")
def officers(u):
    return vendor.officers(records(u)).drop("total_pay")


@query("src11_valuation_fields", f"SELECT s.ticker, collected_at, CAST(current_price AS DOUBLE) AS pe_trailing, CAST(NULL AS DOUBLE) AS pe_forward, beta / 100 AS dividend_yield, CAST(collected_at AS DATE) AS ex_dividend_date {_S}", r="pe_trailing dividend_yield")
def valuation(u):
    return vendor.valuation_fields(records(u)).select("ticker", "collected_at", "pe_trailing", "pe_forward", "dividend_yield", "ex_dividend_date")


@query("src11_holder_stats", f"SELECT s.ticker, collected_at, CAST(market_cap AS DOUBLE) AS shares_outstanding {_S}", r="shares_outstanding")
def stats(u):
    return vendor.holder_stats(records(u)).select("ticker", "collected_at", "shares_outstanding")


@query("src11_holders", f"SELECT s.ticker, 'institutional' AS kind, company_name AS holder, CAST(market_cap AS DOUBLE) AS shares, CAST(current_price AS DOUBLE) AS value, CAST(collected_at AS DATE) AS reported {_S}", r="shares value")
def holders(u):
    return vendor.holders(records(u)).drop("percent")


@query("src11_earnings_quarters", f"SELECT s.ticker, CAST(collected_at AS DATE) AS quarter, CAST(current_price AS DOUBLE) AS eps_estimate, CAST(beta AS DOUBLE) AS eps_actual, CAST(NULL AS DOUBLE) AS surprise_pct {_S}", r="eps_estimate eps_actual")
def earnings(u):
    return vendor.earnings_quarters(records(u))
