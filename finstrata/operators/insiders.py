"""Insider filings and trades (INS-1, 2, 4..12).

A company's trades may be many, its trading days are not: totals are partial aggregates, and the
order-dependent cluster rule runs over at most one row per company and day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finstrata.functions.scale import asof_lookup
from finstrata.session import ensure_checkpoint_dir

# Windows in days, cluster rule, decimal-shift check, forms.
WINDOWS = (("3m", 91), ("6m", 182), ("12m", 365))
CLUSTER_DAYS, CLUSTER_BUYERS = 30, 3
DECIMAL_SHIFT, PRICE_TOLERANCE = 1000.0, 0.10
FORM4_FORMS = ("4", "4/A")


def form4_refs(feed: DataFrame, since: Column) -> DataFrame:
    """Feed pages in column layout (arrays) to one row per Form 4 or 4/A filed on or after *since*."""
    cols = ("accessionNumber", "form", "filingDate", "reportDate", "primaryDocument")
    keys = [c for c in feed.columns if c not in cols]
    flat = feed.select(*keys, F.explode(F.arrays_zip(*cols)).alias("f")).select(*keys, "f.*")
    return (flat.where(F.col("form").isin(*FORM4_FORMS) & (F.to_date("filingDate") >= since)
                       & F.col("primaryDocument").isNotNull() & (F.col("primaryDocument") != ""))
            .select(*keys, F.col("accessionNumber").alias("accession"), "form", F.to_date("filingDate").alias("filed"),
                    F.to_date("reportDate").alias("period_of_report"), "primaryDocument"))


def company_filings(filings: DataFrame, companies: DataFrame, predecessors: DataFrame) -> DataFrame:
    """Filings whose issuer is the company, and its predecessor's from before the company's own first.

    *filings*: accession, issuer_cik, filed; *companies*: ticker, cik; *predecessors*: ticker, predecessor_cik.
    """
    own = filings.join(companies.select("ticker", F.col("cik").alias("issuer_cik")), "issuer_cik")
    first = own.groupBy("ticker").agg(F.min("filed").alias("__first"))
    old = (filings.join(predecessors.select("ticker", F.col("predecessor_cik").alias("issuer_cik")), "issuer_cik")
           .join(first, "ticker", "left").where(F.col("__first").isNull() | (F.col("filed") < F.col("__first"))).drop("__first"))
    return own.unionByName(old)


def price_suspect(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """Adds ``close`` and ``price_suspect``: the price is a thousand times, or a thousandth of, the day's close."""
    j = asof_lookup(trades, bars.select("ticker", F.col("date").alias("bar_date"), "close"), ["ticker"], "date", "bar_date", ["close"]).drop("bar_date_found")
    c, p = F.col("close"), F.col("price")
    near = (F.abs(p / DECIMAL_SHIFT - c) <= PRICE_TOLERANCE * c) | (F.abs(p * DECIMAL_SHIFT - c) <= PRICE_TOLERANCE * c)
    return j.withColumn("price_suspect", F.when(p.isNotNull() & (c != 0), near))


def _order(filed: str, form: str, accession: str) -> Column:
    return F.struct(F.coalesce(F.col(filed).cast("string"), F.lit("")), F.col(form) == "4/A", F.col(accession))


def amended_by(filings: DataFrame) -> DataFrame:
    """(accession, amends): the filing each 4/A amends.

    Same company and a shared owner, filed on the 4/A's original filing day and before it; of several the one of
    its period of report, then the latest. *filings*: one row per filing and owner.
    """
    a = filings.where((F.col("form") == "4/A") & F.col("original_filed").isNotNull()).select(
        "ticker", "owner_cik", F.col("original_filed").alias("filed_date"), "accession",
        F.col("period_of_report").alias("__p"), _order("filed_date", "form", "accession").alias("__o"))
    e = filings.select("ticker", "owner_cik", "filed_date", F.col("accession").alias("amends"),
                       F.col("period_of_report").alias("__ep"), _order("filed_date", "form", "accession").alias("__eo"))
    j = a.join(e, ["ticker", "owner_cik", "filed_date"]).where(F.col("__eo") < F.col("__o"))
    best = F.max_by("amends", F.struct(F.col("__ep").eqNullSafe(F.col("__p")), F.col("__eo")))
    return j.groupBy("accession").agg(best.alias("amends"))


def amendment_chains(filings: DataFrame) -> DataFrame:
    """(accession, root): every amended or amending filing with the first filing of its chain.

    Pointers are doubled until none moves, so a chain of n filings takes log2(n) rounds; an amendment points to an
    earlier filing only, so there is no circle. Each round's table is checkpointed.
    """
    ensure_checkpoint_dir(filings.sparkSession)
    edges = amended_by(filings)
    ptr = edges.select("accession", F.col("amends").alias("root")).checkpoint()
    while True:
        up = ptr.select(F.col("accession").alias("root"), F.col("root").alias("__up"))
        step = ptr.join(up, "root", "left").select("accession", F.coalesce("__up", "root").alias("root"),
                                                   F.col("__up").isNotNull().alias("__moved")).checkpoint()
        ptr = step.drop("__moved")
        if step.where("__moved").isEmpty():
            break
    roots = ptr.select(F.col("root").alias("accession"), "root").distinct()
    return ptr.unionByName(roots)


# What a restated trade must agree in, most alike first.
LIKENESS = (("table", "code", "day", "amount"), ("table", "day", "amount"), ("table", "code", "amount"), ("table", "code", "day"))


def _in_turn(trades: DataFrame, keys: tuple[str, ...], name: str) -> DataFrame:
    """Trades numbered within their chain and key, in filing order; ``name`` is the trade."""
    w = Window.partitionBy("root", *keys).orderBy("filing_rank", "seq")
    return trades.select("root", *keys, F.row_number().over(w).alias("turn"), F.struct("accession", "seq").alias(name))


def restated_trades(filings: DataFrame, trades: DataFrame) -> DataFrame:
    """(accession, seq, restated_by): trades an amendment of their chain restates, matched one for one.

    Amendments of all chains go in step, first to last. In each of four passes of falling likeness the n-th trade of an
    amendment with a key takes over the n-th earlier trade of its chain with that key which still stands; what both
    sides have left goes on to the next pass. Only filings in amendment chains take part.
    """
    chains = amendment_chains(filings)
    order = filings.groupBy("accession").agg(F.min(_order("filed_date", "form", "accession")).alias("__o"))
    w = Window.partitionBy("root").orderBy("__o")
    ranked = chains.join(order, "accession").withColumn("filing_rank", F.row_number().over(w)).drop("__o")
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\x00"))
    title = F.lower(F.trim(F.regexp_replace(F.coalesce("security_title", F.lit("")), r"\s+", " ")))
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).cast("string")
    t = trades.select("accession", F.col("seq").cast("long").alias("seq"), F.concat_ws("\x01", known("kind"), title).alias("table"), known("code").alias("code"), known("date").alias("day"),
                      F.concat_ws("\x01", number("shares"), number("price")).alias("amount")).join(ranked, "accession").checkpoint()
    last = t.agg(F.max("filing_rank")).first()[0] or 1
    taken = t.select("accession", "seq", F.col("accession").alias("restated_by")).limit(0)
    for rank in range(2, last + 1):
        mine = t.where(F.col("filing_rank") == rank)
        standing = t.where(F.col("filing_rank") < rank).join(taken, ["accession", "seq"], "left_anti")
        for keys in LIKENESS:
            pairs = _in_turn(standing, keys, "old").join(_in_turn(mine, keys, "new"), ["root", *keys, "turn"]).select("old", "new").checkpoint()
            taken = taken.unionByName(pairs.select("old.accession", "old.seq", F.col("new.accession").alias("restated_by")))
            standing = standing.join(pairs.select("old.*"), ["accession", "seq"], "left_anti")
            mine = mine.join(pairs.select("new.*"), ["accession", "seq"], "left_anti")
    return taken


def filing_buyer(filings: DataFrame) -> DataFrame:
    """The one owner a filing's trades are read as: its CEO or CFO first, else the lowest CIK."""
    cols = [c for c in filings.columns if c != "accession"]
    key = F.struct((~F.coalesce(F.col("is_ceo_cfo"), F.lit(False))).alias("a"), F.col("owner_cik").alias("b"))
    return filings.groupBy("accession").agg(F.min_by(F.struct(*cols), key).alias("s")).select("accession", "s.*")


def _value() -> Column:
    return F.when(~F.coalesce(F.col("price_suspect"), F.lit(False)), F.col("shares") * F.col("price"))


def _market(trades: DataFrame) -> DataFrame:
    t = trades
    if "kind" in t.columns:
        t = t.where(F.coalesce("kind", F.lit("nonderivative")) == "nonderivative")
    if "price_suspect" not in t.columns:
        t = t.withColumn("price_suspect", F.lit(False))
    return t.where(F.col("date").isNotNull()).withColumn("__v", _value())


def window_totals(trades: DataFrame, as_of: Column, windows=WINDOWS) -> DataFrame:
    """Per company: shares and dollars bought and sold, net, distinct buyers and sellers in each window."""
    t = _market(trades).where(F.col("code").isin("P", "S"))
    aggs = []
    for label, days in windows:
        inside = F.col("date") >= F.date_sub(as_of, days)
        buy, sell = inside & (F.col("code") == "P"), inside & (F.col("code") == "S")
        bought = F.coalesce(F.sum(F.when(buy, F.col("__v"))), F.lit(0.0))
        sold = F.coalesce(F.sum(F.when(sell, F.col("__v"))), F.lit(0.0))
        aggs += [F.coalesce(F.sum(F.when(buy, F.col("shares"))), F.lit(0.0)).alias(f"bought_shares_{label}"),
                 bought.alias(f"bought_value_{label}"),
                 F.coalesce(F.sum(F.when(sell, F.col("shares"))), F.lit(0.0)).alias(f"sold_shares_{label}"),
                 sold.alias(f"sold_value_{label}"), (bought - sold).alias(f"net_value_{label}"),
                 F.countDistinct(F.when(buy, F.col("owner_cik"))).alias(f"buyers_{label}"),
                 F.countDistinct(F.when(sell, F.col("owner_cik"))).alias(f"sellers_{label}")]
    return t.groupBy("ticker").agg(*aggs)


def chief_buys(trades: DataFrame, as_of: Column, days: int = 365) -> DataFrame:
    """The CEO and CFO buys of the trailing year, one row per filing."""
    t = _market(trades).where((F.col("code") == "P") & F.col("is_ceo_cfo") & (F.col("date") >= F.date_sub(as_of, days)))
    return t.groupBy("ticker", "accession").agg(
        F.min("date").alias("date"), F.max("date").alias("last_date"), F.sum("shares").alias("shares"),
        F.coalesce(F.sum("__v"), F.lit(0.0)).alias("value"))


def buyers_ahead(trades: DataFrame, days: int = CLUSTER_DAYS) -> DataFrame:
    """Per company and purchase day: distinct buyers, shares and dollars of that day and the *days* after it.

    A purchase is offered only to the start days that can hold it (days + 1 at most), never to every other
    purchase of the company.
    """
    buys = _market(trades).where(F.col("code") == "P")
    owners = buys.groupBy("ticker", "date", "owner_cik").agg(F.sum("shares").alias("shares"), F.sum("__v").alias("value"))
    starts = owners.select("ticker", F.col("date").alias("start")).distinct()
    offered = owners.withColumn("start", F.explode(F.transform(F.sequence(F.lit(0), F.lit(days)), lambda k: F.date_sub(F.col("date"), k))))
    return (offered.join(starts, ["ticker", "start"]).groupBy("ticker", "start").agg(
        F.countDistinct("owner_cik").alias("buyers"), F.max("date").alias("end"), F.sum("shares").alias("shares"),
        F.coalesce(F.sum("value"), F.lit(0.0)).alias("value")))


def clusters(trades: DataFrame, days: int = CLUSTER_DAYS, buyers: int = CLUSTER_BUYERS) -> DataFrame:
    """Runs of purchases by enough insiders within *days* of the run's first; a purchase is in one run at most.

    Greedy over start days: a run is taken when it qualifies and starts after the last one taken has ended.
    """
    ok = buyers_ahead(trades, days).where(F.col("buyers") >= buyers)
    packed = ok.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("start", "end", "buyers", "shares", "value"))).alias("s"))
    taken = F.aggregate(
        "s", F.struct(F.lit("0001-01-01").cast("date").alias("busy"), F.slice("s", 1, 0).alias("out")),
        lambda acc, x: F.when(x["start"] > acc["busy"], F.struct(
            F.date_add(x["start"], days).alias("busy"), F.concat(acc["out"], F.array(x)).alias("out"))).otherwise(acc))
    return packed.select("ticker", F.explode(taken["out"]).alias("c")).select("ticker", "c.*")


def largest_cluster(trades: DataFrame, days: int = CLUSTER_DAYS) -> DataFrame:
    """The screener's variant: the most distinct buyers any purchase day sees within the *days* after it."""
    return buyers_ahead(trades, days).groupBy("ticker").agg(F.max("buyers").alias("largest_cluster"))


def planned_sale_share(trades: DataFrame, as_of: Column, days: int = 365) -> DataFrame:
    """Share of the sold shares sold under a plan, of the sales that say."""
    t = _market(trades).where((F.col("code") == "S") & (F.col("date") >= F.date_sub(as_of, days)) & F.col("aff10b5one").isNotNull())
    total = F.sum("shares")
    return t.groupBy("ticker").agg((F.coalesce(F.sum(F.when(F.col("aff10b5one"), F.col("shares"))), F.lit(0.0))
                                    / F.nullif(total, F.lit(0.0))).alias("planned_sale_share"))


# What a transaction code means.
CODE_MEANINGS = {"P": "open-market purchase", "S": "open-market sale", "A": "grant or award", "D": "sale to the issuer",
                 "F": "tax withholding", "G": "gift", "M": "option exercise", "X": "option exercise", "C": "conversion"}


def insider_view(trades: DataFrame, buyers: DataFrame, vendor: DataFrame) -> DataFrame:
    """Trades with their filing's buyer, role, meaning and dollars; vendor rows for companies without filings."""
    b = buyers.select("accession", "owner_cik", "officer_title", "is_director", "is_ten_percent")
    t = _market(trades)
    t = t.drop(*[c for c in ("owner_cik",) if c in t.columns]).join(b, "accession", "left")
    role = F.array_join(F.array_compact(F.array(
        F.coalesce(F.nullif(F.col("officer_title"), F.lit("")), F.when(F.col("is_director"), F.lit("Director"))),
        F.when(F.col("is_ten_percent"), F.lit("10% owner")))), ", ")
    meaning = F.coalesce(*[F.when(F.col("code") == k, F.lit(v)) for k, v in CODE_MEANINGS.items()], F.lit("—"))
    own = t.select("ticker", "date", "accession", F.col("owner_cik").cast("string").alias("owner"), F.coalesce(F.nullif(role, F.lit("")), F.lit("—")).alias("role"),
                   "code", meaning.alias("meaning"), "shares", "price", F.col("__v").alias("value"), F.lit("filing").alias("source"))
    v = vendor.join(trades.select("ticker").distinct(), "ticker", "left_anti").select(
        "ticker", "date", F.lit(None).cast("string").alias("accession"), "owner", F.lit("—").alias("role"), "code",
        meaning.alias("meaning"), "shares", "price", (F.col("shares") * F.col("price")).alias("value"), F.lit("vendor").alias("source"))
    return own.unionByName(v)
