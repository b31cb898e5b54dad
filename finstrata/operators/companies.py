"""Company queries (QRY-1..20): listings, latest rows, comparisons, peers, composed views.

"Latest" is always a ``max_by`` aggregate, which combines map-side, and medians over a sector go through
the exact distributed percentiles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finstrata.functions.scale import exact_percentiles

HEADLINE = ("roic", "roe", "net_margin", "debt_to_ebitda")


def latest(rel: DataFrame, order: str, key: str = "ticker", tie: str | None = None) -> DataFrame:
    """The latest row of each key by *order* (and *tie*)."""
    cols = [c for c in rel.columns if c != key]
    by = F.struct(order, tie) if tie else F.col(order)
    return rel.groupBy(key).agg(F.max_by(F.struct(*cols), by).alias("__r")).select(key, "__r.*")


def list_companies(companies: DataFrame, sector: str | None = None, search: str | None = None,
                   limit: int | None = None, offset: int = 0) -> DataFrame:
    """Companies by sector and by a substring of ticker or name (case aside), ordered by ticker."""
    c = matching(companies, sector, search).orderBy("ticker")
    if offset:
        c = c.offset(offset)
    return c.limit(limit) if limit is not None else c


def matching(companies: DataFrame, sector: str | None = None, search: str | None = None) -> DataFrame:
    c = companies
    if sector is not None:
        c = c.where(F.col("sector_class") == sector)
    if search:
        s = search.upper()
        c = c.where(F.upper("ticker").contains(s) | F.upper("company_name").contains(s))
    return c


def count_companies(companies: DataFrame, sector: str | None = None, search: str | None = None) -> DataFrame:
    return matching(companies, sector, search).agg(F.count("*").alias("n"))


def sectors(companies: DataFrame) -> DataFrame:
    return companies.where(F.col("sector_class").isNotNull()).select("sector_class").distinct()


def sic_codes(companies: DataFrame) -> DataFrame:
    return companies.where(F.col("sic").isNotNull()).select("ticker", "sic", "sic_description")


def search_hits(companies: DataFrame, text: str, limit: int | None = None) -> DataFrame:
    """Ticker prefix matches first, then names that contain the text."""
    s = text.upper()
    rank = F.when(F.upper("ticker") == s, 0).when(F.upper("ticker").startswith(s), 1).otherwise(2)
    hits = matching(companies, search=text).withColumn("rank", rank).orderBy("rank", "ticker")
    return (hits if limit is None else hits.limit(limit)).select("ticker", "company_name", "rank")


def overview(companies: DataFrame, snapshots: DataFrame, annual: DataFrame, metrics: DataFrame) -> DataFrame:
    """Each company with its latest snapshot, annual and metric rows (structs)."""
    def packed(rel: DataFrame, order: str, name: str) -> DataFrame:
        cols = [c for c in rel.columns if c != "ticker"]
        return rel.groupBy("ticker").agg(F.max_by(F.struct(*cols), order).alias(name))
    return (companies.join(packed(snapshots, "collected_at", "snapshot"), "ticker", "left")
            .join(packed(annual, "fiscal_year", "annual"), "ticker", "left").join(packed(metrics, "fiscal_year", "metrics"), "ticker", "left"))


def statements(rel: DataFrame, n: int, order: str = "fiscal_year") -> DataFrame:
    """The latest *n* period rows of each company; a company has few periods."""
    w = Window.partitionBy("ticker").orderBy(F.desc(order))
    return rel.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= n).drop("__k")


def series_of(rel: DataFrame, column: str, order: str = "fiscal_year") -> DataFrame:
    """One column as a series; an unknown column is refused."""
    if column not in rel.columns:
        raise ValueError(f"unknown column {column!r}")
    return rel.select("ticker", order, F.col(column).alias("value")).where(F.col("value").isNotNull())


def snapshot_history(snapshots: DataFrame, limit: int) -> DataFrame:
    return statements(snapshots, limit, "collected_at")


def company_rows(rel: DataFrame, ticker: str) -> DataFrame:
    return rel.where(F.col("ticker") == ticker)


def market_series(series: DataFrame, names: Sequence[str]) -> DataFrame:
    return series.where(F.col("series").isin(*names)).orderBy("series", "date")


def holders_by_type(holders: DataFrame, kind: str, limit: int | None = None) -> DataFrame:
    h = holders.where(F.col("kind") == kind).orderBy(F.desc_nulls_last("pct"), "holder")
    return h.limit(limit) if limit else h


def profile(companies: DataFrame, officers: DataFrame) -> DataFrame:
    """Companies with their officers as an array by pay (a company has few officers)."""
    o = officers.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("pay", "name", "title")), asc=False).alias("officers"))
    return companies.join(o, "ticker", "left")


def summaries(companies: DataFrame, snapshots: DataFrame, bars: DataFrame, quality: DataFrame, n: int = 63) -> DataFrame:
    """Watchlist rows: latest quote, the last *n* closes as an array, the latest quality."""
    w = Window.partitionBy("ticker").orderBy(F.desc("date"))
    closes = (bars.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= n).groupBy("ticker")
              .agg(F.transform(F.sort_array(F.collect_list(F.struct("date", "close"))), lambda s: s["close"]).alias("closes")))
    quote = latest(snapshots, "collected_at").select("ticker", "current_price", "previous_close", "market_cap")
    return (companies.select("ticker", "company_name").join(quote, "ticker", "left").join(closes, "ticker", "left")
            .join(latest(quality, "fiscal_year").select("ticker", "quality_score"), "ticker", "left"))


def compare(metrics: DataFrame, tickers: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Metric rows by ticker columns, on each ticker's latest year."""
    unknown = [m for m in names if m not in metrics.columns]
    if unknown:
        raise ValueError(f"unknown metrics {unknown}")
    rows = latest(metrics.where(F.col("ticker").isin(*tickers)), "fiscal_year")
    return rows.unpivot(["ticker"], list(names), "metric", "value").groupBy("metric").pivot("ticker", list(tickers)).agg(F.max("value"))


def _year_rows(metrics: DataFrame, fiscal_year: int | None) -> DataFrame:
    return latest(metrics, "fiscal_year") if fiscal_year is None else metrics.where(F.col("fiscal_year") == fiscal_year)


def sector_medians(metrics: DataFrame, companies: DataFrame, names: Sequence[str], sector: str | None = None,
                   fiscal_year: int | None = None) -> DataFrame:
    """(sector_class, metric, median, n): exact medians of each metric; a metric without values is left out."""
    c = companies.select("ticker", "sector_class")
    if sector is not None:
        c = c.where(F.col("sector_class") == sector)
    rows = _year_rows(metrics, fiscal_year).join(c, "ticker")
    long = rows.unpivot(["ticker", "sector_class"], list(names), "metric", "value")
    return exact_percentiles(long, ["sector_class", "metric"], "value", {"median": 0.5}, "n")


def sector_aggregates(metrics: DataFrame, companies: DataFrame, quality: DataFrame, fiscal_year: int | None = None) -> DataFrame:
    """Per sector: companies, median quality and the headline medians."""
    c = companies.where(F.col("sector_class").isNotNull())
    n = c.groupBy("sector_class").agg(F.count("*").alias("n"))
    q = _year_rows(quality, fiscal_year).join(c.select("ticker", "sector_class"), "ticker").withColumn("quality_score", F.col("quality_score").cast("double"))
    mq = exact_percentiles(q, ["sector_class"], "quality_score", {"median_quality": 0.5})
    m = sector_medians(metrics, companies, HEADLINE, None, fiscal_year).groupBy("sector_class").pivot("metric", list(HEADLINE)).agg(F.max("median"))
    return n.join(mq, "sector_class", "left").join(m, "sector_class", "left")


def peers(ticker: str, metrics: DataFrame, companies: DataFrame, names: Sequence[str]) -> DataFrame:
    """The company's latest metrics beside its sector's medians and the number of peers."""
    own = companies.where(F.col("ticker") == ticker).select("sector_class")
    mates = companies.join(own, "sector_class", "left_semi")
    count = mates.agg(F.count("*").alias("n_peers"))
    med = sector_medians(metrics, mates, names).select("metric", F.col("median").alias("sector_median"))
    mine = latest(metrics.where(F.col("ticker") == ticker), "fiscal_year").unpivot(["ticker"], list(names), "metric", "company")
    return mine.join(med, "metric", "left").crossJoin(F.broadcast(count)).select("metric", "company", "sector_median", "n_peers")


def runs(collection_runs: DataFrame, ticker: str | None = None, limit: int | None = None) -> DataFrame:
    r = collection_runs if ticker is None else collection_runs.where(F.col("ticker") == ticker)
    r = r.orderBy(F.desc("collected_at"), F.desc("run_id"), "ticker")
    return r if limit is None else r.limit(limit)


def run_warnings(collection_runs: DataFrame) -> DataFrame:
    """Each run's warnings (JSON text) as rows."""
    return collection_runs.select("ticker", "run_id", F.explode(F.from_json("warnings", "array<string>")).alias("warning"))


def unmapped(facts: DataFrame, limit: int | None = None) -> DataFrame:
    rows = facts.orderBy(F.desc("end"), F.desc(F.abs("val")), "tag", "ticker")
    return rows if limit is None else rows.limit(limit)


def bars_stored_at(collection_runs: DataFrame, refresh_log: DataFrame) -> DataFrame:
    """When a company's bars were last stored: its latest run, or a later refresh whose bar update names it.

    *refresh_log*: at, updated MAP<ticker, details>.
    """
    a = collection_runs.groupBy("ticker").agg(F.max("collected_at").alias("__a"))
    b = refresh_log.select("at", F.explode(F.map_keys("updated")).alias("ticker")).groupBy("ticker").agg(F.max("at").alias("__b"))
    return a.join(b, "ticker", "full_outer").select("ticker", F.greatest("__a", "__b").alias("stored_at"))


def company_view(companies: DataFrame, sections: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """One row per company, each section an array of its rows in order (sections are a company's own few rows)."""
    out = companies
    for name, (rel, order) in sections.items():
        cols = [order] + [c for c in rel.columns if c not in ("ticker", order)]
        g = rel.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
        out = out.join(g, "ticker", "left")
    return out


def statement_table(rel: DataFrame, lines: Sequence[str], periods: Sequence, order: str = "fiscal_year") -> DataFrame:
    """Line items by period columns; a company's line without any value is dropped."""
    long = rel.where(F.col(order).isin(*periods)).unpivot(["ticker", order], list(lines), "line", "value").where(F.col("value").isNotNull())
    return long.groupBy("ticker", "line").pivot(order, list(periods)).agg(F.max("value"))


def last_bar(bars: DataFrame) -> DataFrame:
    return bars.groupBy("ticker").agg(F.max("date").alias("last_bar"))


def last_fetch(fetches: DataFrame) -> DataFrame:
    return latest(fetches, "fetched_at", "source")
