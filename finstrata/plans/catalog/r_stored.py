"""SNK and INC-4 over stored tables: batches are written in place, derived tables follow the buckets that changed."""

import uuid

from pyspark.sql import functions as F

from finstrata.operators import ratios as rat
from finstrata.plans.catalog import h_queries as H
from finstrata.plans.catalog import j_store as J
from finstrata.plans.catalog._core import query
from finstrata.session import ensure_checkpoint_dir
from finstrata.stored import StoredTable

_BUCKETS = 16


def stored(u, name, *batches, key=None):
    """A new table with the *batches* stored in turn; each is sent twice, as by a job that was started again."""
    root = f"{ensure_checkpoint_dir(u.spark).rstrip('/')}/stored/{uuid.uuid4().hex}"
    t = StoredTable(u.spark, root, name, _BUCKETS, key)
    for k, b in enumerate(batches):
        t.write(b, f"run-{k}")
        t.write(b, f"run-{k}")
    return t


@query("snk1_stored_upsert", f"SELECT * FROM ({J._OLD}) o WHERE NOT EXISTS (SELECT 1 FROM ({J._NEW}) n WHERE n.ticker = o.ticker AND n.fiscal_year = o.fiscal_year) UNION ALL {J._NEW}")
def snk1_stored(u):
    return stored(u, "financials_annual", J._old(u), J._new(u)).read()


@query("snk2_stored_keep_existing", """SELECT c.ticker, coalesce(n.sic, c.sic) AS sic, c.sector_class FROM si_company c
LEFT JOIN (SELECT ticker, CASE WHEN company_no % 2 = 0 THEN 'new' END AS sic FROM si_company WHERE company_no % 3 = 0) n ON n.ticker = c.ticker""")
def snk2_stored(u):
    no = F.col("company_no")
    new = u.company.where(no % 3 == 0).select("ticker", F.when(no % 2 == 0, "new").alias("sic"))
    return stored(u, "companies", u.company.select("ticker", F.col("sic").cast("string").alias("sic"), "sector_class"), new).read()


@query("snk4_stored_replace", """SELECT ticker, kind, holder, pct FROM si_holders WHERE kind = 'fund' AND pct > 10
UNION ALL SELECT ticker, kind, holder, pct FROM si_holders WHERE ticker NOT IN (SELECT ticker FROM si_holders WHERE kind = 'fund' AND pct > 10)""")
def snk4_stored(u):
    h = u.holders.select("ticker", "kind", "holder", "pct")
    return stored(u, "holders", h, h.where((F.col("kind") == "fund") & (F.col("pct") > 10))).read()


@query("snk5_stored_from_date", """SELECT ticker AS series, date, close AS value FROM si_bars WHERE date < DATE '2001-03-01'
UNION ALL SELECT ticker, date, close * 2 FROM si_bars WHERE date >= DATE '2001-03-01'""")
def snk5_stored(u):
    b = u.bars.select(F.col("ticker").alias("series"), "date", F.col("close").alias("value"))
    new = b.where(F.col("date") >= F.lit("2001-03-01").cast("date")).withColumn("value", F.col("value") * 2)
    return stored(u, "market_series", b, new).read()


_KEPT = ["ticker", "fiscal_year", "roe", "net_margin", "asset_turnover"]


@query("inc4_stored_refresh", f"SELECT {', '.join(_KEPT)} FROM ox_ratio", r="roe net_margin asset_turnover")
def inc4_stored(u):
    """Ratios derived from years that are stored wrong for some companies, then right: the second refresh computes the
    buckets of those companies alone."""
    annual = H.annual(u)
    off = F.pmod(F.xxhash64("ticker"), F.lit(_BUCKETS * 4)) == 0
    first = annual.withColumn("revenue", F.when(off, F.col("revenue") * 3 + 1).otherwise(F.col("revenue")))
    years = stored(u, "financials_annual", first)
    derived = StoredTable(u.spark, years.path, "ratios_annual", _BUCKETS, "ticker")
    compute = lambda t: rat.ratios(t["annual"], keep=["ticker", "fiscal_year", "sector_class"]).select(*_KEPT)
    derived.refresh({"annual": years}, compute)
    years.write(annual.where(off), "correction")
    derived.refresh({"annual": years}, compute)
    return derived.read()
