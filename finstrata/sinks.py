"""Writing rules as DataFrame merges, and the files written from them (SNK-1..13)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], mode: str = "overwrite") -> DataFrame:
    """The table after storing *new*: ``overwrite`` (new rows win), ``keep_existing`` (a new NULL keeps the stored
    value), ``fill_only`` (only stored NULLs are filled)."""
    k = list(keys)
    if mode == "overwrite":
        return old.join(new.select(*k), k, "left_anti").unionByName(new, allowMissingColumns=True)
    if mode not in ("keep_existing", "fill_only"):
        raise ValueError(f"unknown mode {mode!r}")
    values = [c for c in dict.fromkeys(old.columns + new.columns) if c not in k]
    n = new.select(*k, *[F.col(c).alias(f"__n_{c}") for c in new.columns if c not in k])
    j = old.join(n, k, "full_outer")

    def pick(c: str) -> Column:
        a = F.col(c) if c in old.columns else None
        b = F.col(f"__n_{c}") if c in new.columns else None
        order = [b, a] if mode == "keep_existing" else [a, b]
        return F.coalesce(*[x for x in order if x is not None]).alias(c)

    return j.select(*k, *[pick(c) for c in values])


def replace_by_key(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All stored rows of the keys present in the batch give way to the batch."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def replace_from_date(old: DataFrame, new: DataFrame, key: str, day: str = "date", starts: DataFrame | None = None) -> DataFrame:
    """Stored rows of a key from the batch's first day (or *starts*: key, start) on give way; earlier ones stay."""
    s = starts if starts is not None else new.groupBy(key).agg(F.min(day).alias("start"))
    kept = old.join(s, key, "left").where(F.col("start").isNull() | (F.col(day) < F.col("start"))).drop("start")
    return kept.unionByName(new, allowMissingColumns=True)


def replace_if_any(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """A run's rows replace a key's stored ones only where the run has some."""
    return replace_by_key(old, new, [key])


def append_capped(old: DataFrame, new: DataFrame, key: str, order: str, keep: int | None = None) -> DataFrame:
    """A key's log with the new entries; its latest *keep* only, if given."""
    both = old.unionByName(new, allowMissingColumns=True)
    if keep is None:
        return both
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return both.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= keep).drop("__k")


def merge_run(old: dict[str, DataFrame], new: dict[str, DataFrame], keep_snapshots: int | None = None, keep_runs: int | None = None) -> dict[str, DataFrame]:
    """A company record across runs: periods by union, info gap-filled, logs appended, empty sections kept.

    *keep_snapshots* and *keep_runs* are retention rules a caller may set; nothing is dropped by default.
    """
    return {
        "periods": merge_upsert(old["periods"], new["periods"], ["ticker", "period_end"], "overwrite"),
        "info": merge_upsert(old["info"], new["info"], ["ticker"], "fill_only"),
        "snapshots": append_capped(old["snapshots"], new["snapshots"], "ticker", "collected_at", keep_snapshots),
        "runs": append_capped(old["runs"], new["runs"], "ticker", "collected_at", keep_runs),
        "holders": replace_if_any(old["holders"], new["holders"], "ticker"),
    }


def dedupe_filings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Filings once per (accession, date, form), the new run's row winning."""
    both = old.withColumn("__src", F.lit(0)).unionByName(new.withColumn("__src", F.lit(1)), allowMissingColumns=True)
    keys = ["ticker", "accession", "date", "form"]
    rest = [c for c in both.columns if c not in keys + ["__src"]]
    g = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__src").alias("__r"))
    return g.select(*keys, "__r.*")


def summary_export(companies: DataFrame, latest: dict[str, DataFrame]) -> DataFrame:
    """One flat row per company: each section's latest row with prefixed columns."""
    out = companies
    for name, df in latest.items():
        cols = [F.col(c).alias(f"{name}_{c}") for c in df.columns if c != "ticker"]
        out = out.join(df.select("ticker", *cols), "ticker", "left")
    return out


def history_export(stored: DataFrame, annual: DataFrame) -> DataFrame:
    """The company-year file: new figures win where they have a value."""
    return merge_upsert(stored, annual, ["ticker", "fiscal_year"], "keep_existing")


def company_json(companies: DataFrame, sections: dict[str, DataFrame]) -> DataFrame:
    """(ticker, json): a company's record as one document; sections are the company's own rows."""
    out = companies
    for name, df in sections.items():
        cols = [c for c in df.columns if c != "ticker"]
        out = out.join(df.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name)), "ticker", "left")
    return out.select("ticker", F.to_json(F.struct(*[c for c in out.columns])).alias("json"))


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


# The rule each stored table is written by.
TABLE_RULES: dict[str, tuple[str, tuple[str, ...]]] = {
    "companies": ("keep_existing", ("ticker",)), "financials_annual": ("overwrite", ("ticker", "fiscal_year")),
    "financials_quarterly": ("overwrite", ("ticker", "period_end")), "financials_ttm": ("overwrite", ("ticker", "period_end")),
    "financials_annual_known": ("replace", ("ticker",)), "dividend_events": ("overwrite", ("ticker", "date")),
    "split_events": ("overwrite", ("ticker", "date")), "earnings_quarters": ("overwrite", ("ticker", "quarter")),
    "price_bars": ("overwrite", ("ticker", "date")), "market_series": ("from_date", ("series",)),
    "holders": ("replace", ("ticker",)), "officers": ("replace", ("ticker",)), "valuations": ("overwrite", ("ticker", "model")),
    "valuation_summary": ("overwrite", ("ticker",)), "valuation_history": ("replace", ("ticker",)), "valuation_ranges": ("replace", ("ticker",)),
    "quality_scores": ("overwrite", ("ticker",)), "warning_signs": ("replace", ("ticker",)), "ranks": ("keep_existing", ("ticker",)),
    "cusip_map": ("overwrite", ("cusip",)), "guru_positions": ("replace", ("manager",)), "insider_trades": ("overwrite", ("accession", "seq")),
}


def write_rows(name: str, old: DataFrame, new: DataFrame) -> DataFrame:
    """The table *name* after storing *new*, by its rule."""
    rule, keys = TABLE_RULES[name]
    if rule == "replace":
        return replace_by_key(old, new, keys)
    if rule == "from_date":
        return replace_from_date(old, new, keys[0])
    return merge_upsert(old, new, keys, rule)


def write_table(name: str, old: DataFrame, new: DataFrame, path: str) -> None:
    """Writes the merged table to a new *path* (never over the one being read)."""
    write_rows(name, old, new).write.mode("errorifexists").parquet(path)
