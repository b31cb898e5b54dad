"""Incremental maintenance (INC-1..10): what a new quote, feed or run changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finstrata.operators.companies import latest
from finstrata.operators.splits import is_share_split
from finstrata.sinks import replace_by_key, write_rows

RETRY_DAYS = 6


def append_quote(snapshots: DataFrame, quotes: DataFrame) -> DataFrame:
    """New snapshot rows: a field the quote lacks is carried forward from the latest stored snapshot."""
    prev = latest(snapshots, "collected_at")
    fields = [c for c in snapshots.columns if c not in ("ticker", "collected_at")]
    p = prev.select("ticker", *[F.col(c).alias(f"__p_{c}") for c in fields])
    j = quotes.join(p, "ticker", "left")
    pick = lambda c: F.coalesce(F.col(c), F.col(f"__p_{c}")) if c in quotes.columns else F.col(f"__p_{c}")
    return j.select("ticker", "collected_at", *[pick(c).alias(c) for c in fields])


def refreshed_ev(metrics: DataFrame, quotes: DataFrame) -> DataFrame:
    """The latest year's EV family on the new quote's market cap."""
    m = latest(metrics, "fiscal_year").join(quotes.select("ticker", F.col("market_cap").alias("__cap")), "ticker")
    ev = F.col("__cap") + F.coalesce("net_debt", F.lit(0.0))
    over = lambda b: F.when(F.col(b) > 0, ev / F.nullif(F.col(b), F.lit(0.0)))
    return m.select("ticker", "fiscal_year", ev.alias("enterprise_value"), over("ebitda").alias("ev_to_ebitda"), over("revenue").alias("ev_to_revenue"),
                    over("free_cash_flow").alias("ev_to_fcf"), F.when(F.col("__cap") > 0, F.col("free_cash_flow") / F.nullif(F.col("__cap"), F.lit(0.0))).alias("fcf_yield"))


def normal_form(form: Column) -> Column:
    """10-K405, 10-KT/A and the like as their base form."""
    return F.regexp_extract(form, r"^(10-K|10-Q|20-F|40-F)", 1)


def to_reload(feed: DataFrame, runs: DataFrame, splits: DataFrame, companies: DataFrame) -> DataFrame:
    """(ticker, reason): companies with a report filed since their last run, an incomplete run, or a later split."""
    last = latest(runs, "collected_at", tie="run_id").select("ticker", F.col("collected_at").alias("__at"), "complete")
    f = feed.withColumn("__f", normal_form(F.col("form"))).where(F.col("__f") != "").join(companies.select("ticker", "cik"), "cik")
    new = f.join(last, "ticker").where(F.col("filed") > F.to_date("__at")).select("ticker", F.lit("new report").alias("reason"))
    part = last.where(~F.col("complete")).select("ticker", F.lit("incomplete").alias("reason"))
    cut = splits.join(last, "ticker").where(F.col("date") > F.to_date("__at")).select("ticker", F.lit("split").alias("reason"))
    return new.unionByName(part).unionByName(cut).distinct()


def incomplete_tries(runs: DataFrame, days: int = RETRY_DAYS) -> DataFrame:
    """(ticker, tries): consecutive incomplete runs back from the latest, counted once per *days* (greedy from the
    oldest); a company has few runs since its last complete one."""
    done = runs.groupBy("ticker").agg(F.max(F.when(F.col("complete"), F.col("collected_at"))).alias("__done"))
    open_ = runs.join(done, "ticker").where(~F.col("complete") & (F.col("__done").isNull() | (F.col("collected_at") > F.col("__done"))))
    # One entry per company and day bounds the list.
    d = open_.select("ticker", F.to_date("collected_at").alias("d")).distinct().groupBy("ticker").agg(F.array_sort(F.collect_list("d")).alias("ds"))
    n = F.aggregate("ds", F.struct(F.lit(None).cast("date").alias("last"), F.lit(0).alias("n")),
                    lambda a, x: F.when(a["last"].isNull() | (F.datediff(x, a["last"]) >= days), F.struct(x.alias("last"), (a["n"] + 1).alias("n"))).otherwise(a))
    return d.select("ticker", n["n"].alias("tries"))


def recompute_changed(stored: DataFrame, changed: DataFrame, compute: Callable[[DataFrame], DataFrame], rank: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """A result table after *compute* over the *changed* companies only (it gets their tickers); *rank* then ranks all rows anew, since one company's change moves others."""
    tickers = changed.select("ticker").distinct()
    rows = replace_by_key(stored, compute(tickers), ["ticker"])
    return rows if rank is None else rank(rows)


def apply_run(tables: dict[str, DataFrame], run: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Every table after a vendor run, each by its own rule; a section the run lacks leaves its table alone."""
    return {n: write_rows(n, t, run[n]) if n in run else t for n, t in tables.items()}


def one_per_cik(members: DataFrame) -> DataFrame:
    """One member per CIK: its Class A share, else the first listed."""
    cols = [c for c in members.columns if c != "cik"]
    key = F.struct((~F.lower("name").contains("class a")).alias("a"), F.col("position").alias("p"))
    return members.groupBy("cik").agg(F.min_by(F.struct(*cols), key).alias("m")).select("cik", "m.*")


def fill_sic(companies: DataFrame, payloads: DataFrame) -> DataFrame:
    """Companies with SIC code and description from stored payloads where they lack one."""
    p = payloads.groupBy("cik").agg(F.max(F.struct("sic", "sic_description")).alias("p"))
    have = F.col("sic").isNotNull()
    return (companies.join(p, "cik", "left").withColumns({
        "sic_description": F.when(have, F.col("sic_description")).otherwise(F.col("p.sic_description")), "sic": F.coalesce("sic", F.col("p.sic"))}).drop("p"))


def served_day(bars: DataFrame, splits: DataFrame, collected: DataFrame) -> DataFrame:
    """(ticker, served_on): the latest of the run's last bar and last split, else the day before the run."""
    b = bars.groupBy("ticker").agg(F.max("date").alias("b"))
    s = splits.groupBy("ticker").agg(F.max("date").alias("s"))
    return (collected.join(b, "ticker", "left").join(s, "ticker", "left")
            .select("ticker", F.coalesce(F.greatest("b", "s"), F.date_sub(F.to_date("collected_at"), 1)).alias("served_on")))


def events_since(bars: DataFrame, dividends: DataFrame, splits: DataFrame) -> DataFrame:
    """(ticker, since): the first day a quote re-reads events from, the earliest of the three tables' last days."""
    out = None
    for df, n in ((bars, "b"), (dividends, "d"), (splits, "s")):
        g = df.groupBy("ticker").agg(F.max("date").alias(n))
        out = g if out is None else out.join(g, "ticker", "full_outer")
    return out.select("ticker", F.least("b", "d", "s").alias("since"))


def moving_factors(splits: DataFrame, since: DataFrame) -> DataFrame:
    """The splits after each company's day that move its per-share figures."""
    return splits.join(since, "ticker").where((F.col("date") > F.col("since")) & is_share_split(F.col("ratio"))).select("ticker", "date", "ratio")


def merge_sections(vendor: DataFrame, filing: DataFrame, rates: DataFrame) -> DataFrame:
    """One company record per run: filing figures first, the vendor's where they lack one, the run's rate."""
    values = [c for c in dict.fromkeys(vendor.columns + filing.columns) if c not in ("ticker", "run_id")]
    f = filing.select("ticker", "run_id", *[F.col(c).alias(f"__f_{c}") for c in filing.columns if c not in ("ticker", "run_id")])
    j = vendor.join(f, ["ticker", "run_id"], "full_outer").join(rates, "run_id", "left")
    pick = lambda c: F.coalesce(*[x for x in (F.col(f"__f_{c}") if c in filing.columns else None, F.col(c) if c in vendor.columns else None) if x is not None])
    return j.select("ticker", "run_id", *[pick(c).alias(c) for c in values], *[c for c in rates.columns if c != "run_id"])
