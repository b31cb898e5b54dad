"""Landed market, ticker and vendor files to rows (SRC-5..12)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The yield columns of the yearly rate files, and cells without a value.
TREASURY = {"1 Mo": "1m", "1.5 Month": "6w", "2 Mo": "2m", "3 Mo": "3m", "4 Mo": "4m", "6 Mo": "6m", "1 Yr": "1y", "2 Yr": "2y", "3 Yr": "3y",
            "5 Yr": "5y", "7 Yr": "7y", "10 Yr": "10y", "20 Yr": "20y", "30 Yr": "30y"}
TREASURY_REQUIRED = ("3 Mo", "2 Yr", "10 Yr")
INDEX_LABELS = {"P": "price", "D": "dividend", "E": "earnings", "CPI": "cpi", "CAPE": "cape"}


def _once(rows: DataFrame, keys: list[str], what: str) -> DataFrame:
    """*rows* with each key once; a repeated key raises when the rows are read."""
    g = rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.first("value").alias("value"))
    guard = F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit(f"{what} twice: "), F.concat_ws(" ", *[F.col(k).cast("string") for k in keys]))).cast("double"))
    return g.select(*keys, F.coalesce(guard, F.col("value")).alias("value"))


def read_fred_csv(spark: SparkSession, path: str, series: str) -> DataFrame:
    """(series, date, value); "." or blank is no value, a wrong header or a date given twice is an error."""
    raw = spark.read.option("header", True).csv(path)
    if raw.columns[0].strip().lower() not in ("observation_date", "date"):
        raise ValueError(f"not a rate series CSV: {raw.columns}")
    cell = F.trim(F.col(f"`{raw.columns[1]}`"))
    rows = raw.select(F.to_date(F.trim(F.col(f"`{raw.columns[0]}`"))).alias("date"), cell.alias("c")).where(~F.coalesce(F.col("c"), F.lit("")).isin("", "."))
    return _once(rows.select(F.lit(series).alias("series"), "date", F.col("c").cast("double").alias("value")), ["series", "date"], "date")


def read_treasury_csv(spark: SparkSession, path: str) -> DataFrame:
    """Yearly wide yields to (series ``ust:<maturity>``, date, value); other columns are ignored."""
    raw = spark.read.option("header", True).csv(path)
    missing = [c for c in TREASURY_REQUIRED if c not in raw.columns]
    if raw.columns[0] != "Date" or missing:
        raise ValueError(f"not a yield curve CSV: {raw.columns}, missing {missing}")
    cols = [c for c in raw.columns if c in TREASURY]
    long = raw.select("Date", *[F.col(f"`{c}`").alias(TREASURY[c]) for c in cols]).unpivot(["Date"], [TREASURY[c] for c in cols], "maturity", "c")
    long = long.where(~F.upper(F.trim(F.coalesce("c", F.lit("")))).isin("", "N/A"))
    return long.select(F.concat(F.lit("ust:"), "maturity").alias("series"), F.to_date(F.trim("Date"), "MM/dd/yyyy").alias("date"), F.trim("c").cast("double").alias("value"))


def decimal_month(c: Column) -> Column:
    """1871.01 -> 1871-01-01, 2026.1 -> 2026-10-01; NULL for a cell that is not such a number."""
    year = F.floor(c).cast("int")
    month = F.round((c - year) * 100).cast("int")
    return F.when(c.between(1000, 9999.99) & month.between(1, 12), F.make_date(year, month, F.lit(1)))


def read_monthly_index(spark: SparkSession, path: str) -> DataFrame:
    """The monthly index sheet landed as CSV: header row found by its labels, each series to its own last value."""
    # Lines above the header may have any number of cells, so lines are split one by one.
    line = F.split("value", r',(?=(?:[^"]*"[^"]*")*[^"]*$)')
    raw = spark.read.text(path).select(F.transform(line, lambda x: F.trim(F.regexp_replace(x, r'^\s*"|"\s*$', ""))).alias("r"))
    wanted = ["Date", *INDEX_LABELS]
    header = raw.where(F.size(F.array_intersect("r", F.array(*map(F.lit, wanted)))) == len(wanted)).select("r").first()
    if header is None:
        raise ValueError(f"{path} has no header row with {', '.join(wanted)}")
    at = lambda name: F.get("r", F.lit(header["r"].index(name)))
    rows = raw
    month = decimal_month(at("Date").try_cast("double"))
    vals = F.array(*[F.struct(F.lit(f"shiller:{n}").alias("series"), at(k).try_cast("double").alias("value")) for k, n in INDEX_LABELS.items()])
    long = rows.select(month.alias("date"), F.explode(vals).alias("v")).where(F.col("date").isNotNull() & F.col("v.value").isNotNull())
    return _once(long.select("v.series", "date", "v.value"), ["series", "date"], "month")


def normalize_ticker(c: Column) -> Column:
    """Upper case, a class share's dot as a dash; NULL for a text that is not a ticker."""
    t = F.trim(c)
    return F.when(t.rlike(r"^[A-Za-z0-9]+(?:[-.][A-Za-z0-9]+)?$"), F.upper(F.replace(t, F.lit("."), F.lit("-"))))


def unique_tickers(texts: DataFrame, text: str = "text", position: str = "position") -> DataFrame:
    """(ticker, position): each ticker once, at its first appearance."""
    return (texts.select(normalize_ticker(F.col(text)).alias("ticker"), position).where(F.col("ticker").isNotNull())
            .groupBy("ticker").agg(F.min(position).alias(position)))


def read_tickers(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, cik, position) of a .txt list (# comments) or a .csv with a ticker or Symbol column, in file order."""
    if path.lower().endswith(".csv"):
        raw = spark.read.option("header", True).csv(path)
        names = {c.strip().lower(): c for c in raw.columns}
        key = names.get("ticker") or names.get("symbol")
        if key is None:
            raise ValueError(f"a CSV of tickers needs a ticker or Symbol column: {raw.columns}")
        cik = F.trim(F.col(f"`{names['cik']}`")) if "cik" in names else F.lit(None).cast("string")
        rows = raw.select(F.col(f"`{key}`").alias("text"), F.when(cik.rlike("^[0-9]{1,10}$"), F.lpad(cik, 10, "0")).alias("cik"))
    else:
        rows = spark.read.text(path).select(F.regexp_replace("value", "#.*$", "").alias("text"), F.lit(None).cast("string").alias("cik"))
    rows = rows.withColumn("position", F.monotonically_increasing_id())
    t = rows.select(normalize_ticker(F.col("text")).alias("ticker"), "cik", "position").where(F.col("ticker").isNotNull())
    return t.groupBy("ticker").agg(F.min_by("cik", F.when(F.col("cik").isNotNull(), F.col("position"))).alias("cik"), F.min("position").alias("position"))


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stored table."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}")


def anti_existing(tickers: DataFrame, companies: DataFrame) -> DataFrame:
    """Tickers not stored yet, by ticker or by CIK."""
    left = tickers.join(companies.select("ticker"), "ticker", "left_anti")
    known = companies.where(F.col("cik").isNotNull()).select(F.col("cik").alias("__cik")).distinct()
    return left.join(known, left["cik"] == F.col("__cik"), "left_anti")


# Vendor fields stored in percent that become fractions.
PERCENT_FIELDS = ("dividend_yield", "five_year_avg_dividend_yield")


def market_data(records: DataFrame, names: dict[str, str]) -> DataFrame:
    """Vendor quote records to snapshot columns (*names*: vendor name -> ours), percents as fractions."""
    return records.select("ticker", "collected_at", *[(F.col(f"`{k}`") / 100 if v in PERCENT_FIELDS else F.col(f"`{k}`")).alias(v) for k, v in names.items()])


def statement_long(records: DataFrame, periods: list[str]) -> DataFrame:
    """A wide vendor statement (line, one column a period end) to (ticker, period_end, line, value)."""
    return (records.unpivot(["ticker", "line"], periods, "period_end", "value").where(F.col("value").isNotNull())
            .select("ticker", F.to_date("period_end").alias("period_end"), "line", "value"))


def pick_column(df: DataFrame, *names: str) -> Column:
    """The first present of alternative vendor column names, NULLs falling through."""
    have = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("double")


def vendor_events(records: DataFrame) -> dict[str, DataFrame]:
    """Vendor run records (ticker, bars, dividends, splits arrays of structs) to event tables."""
    out = {}
    for n in ("bars", "dividends", "splits"):
        out[n] = records.select("ticker", F.explode(n).alias("e")).select("ticker", "e.*").withColumn("date", F.to_date(F.substring("date", 1, 10)))
    return out


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
