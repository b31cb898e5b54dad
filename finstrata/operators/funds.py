"""Institutional (13F) holdings: standing filings, positions, splits and quarter changes (GUR-1..17).

Every step is keyed by filing, security or manager and pre-aggregated; a security held by a third of
all rows is only ever summed, counted or matched by an ordinal within a fully specified row key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finstrata.functions.exprs import next_quarter_end, previous_quarter_end
from finstrata.functions.scale import exact_percentiles
from finstrata.operators.splits import is_simple_ratio, split_product

# Fixed values of the holdings rules.
NEW_HOLDINGS, DEADLINE_DAYS, ROLL_DAYS = "NEW HOLDINGS", 45, 3
DOLLARS_FROM, PRICE_FLOOR, PRICE_CEILING = "2023-01-03", 1.0, 100000.0
SPLIT_RATIOS = tuple(range(2, 11)) + tuple(range(15, 101, 5))
SPLIT_SHARES_TOLERANCE, SPLIT_PRICE_TOLERANCE = 0.05, 1.3
THIRTEENF_FORMS = ("13F-HR", "13F-HR/A")


def quarter_start(day: Column, quarters: int) -> Column:
    return F.add_months(F.trunc(day, "QUARTER"), -3 * quarters)


def filing_deadline(period: Column) -> Column:
    return F.date_add(period, DEADLINE_DAYS + ROLL_DAYS)


def filing_refs(feed: DataFrame, since_period: Column) -> DataFrame:
    """13F-HR and 13F-HR/A filings of periods on or after *since_period* (notices left out)."""
    return feed.where(F.col("form").isin(*THIRTEENF_FORMS) & F.col("filed").isNotNull() & (F.col("period") >= since_period))


def unit_multiplier(filings: DataFrame, holdings: DataFrame) -> DataFrame:
    """(accession, multiplier): thousands before the rule's date, dollars after, unless the median price is impossible."""
    by_date = F.when(F.col("filed") < F.lit(DOLLARS_FROM).cast("date"), 1000.0).otherwise(1.0)
    f = filings.select("accession", by_date.alias("__d"))
    p = holdings.where((F.col("share_type") == "SH") & (F.col("shares") > 0) & F.col("value").isNotNull()).select(
        "accession", (F.col("value") / F.col("shares")).alias("__p"))
    med = exact_percentiles(p, ["accession"], "__p", {"__m": 0.5})
    j = f.join(med, "accession", "left").withColumn("__m", F.col("__m") * F.col("__d"))

    def possible(x: Column) -> Column:
        return x.between(PRICE_FLOOR, PRICE_CEILING)

    return j.select("accession", F.when((F.col("__m") < PRICE_FLOOR) & possible(F.col("__m") * 1000), 1000.0)
                    .when((F.col("__m") > PRICE_CEILING) & possible(F.col("__m") / 1000), 1.0).otherwise(F.col("__d")).alias("multiplier"))


def checksum(filings: DataFrame, holdings: DataFrame) -> DataFrame:
    """(accession, checksum_ok): the cover's entry count and value total agree with the rows, within rounding."""
    rows = holdings.groupBy("accession").agg(F.count("*").alias("__n"), F.sum("value").alias("__v"))
    j = filings.select("accession", "entry_total", "value_total").join(rows, "accession", "left")
    ok = (F.col("entry_total") == F.coalesce("__n", F.lit(0))) & (
        F.abs(F.coalesce("__v", F.lit(0.0)) - F.col("value_total")) <= (F.col("entry_total") + 1) / 2)
    return j.select("accession", F.coalesce(ok, F.lit(False)).alias("checksum_ok"))


def _adds() -> Column:
    return F.upper(F.coalesce("amendment_type", F.lit(""))) == NEW_HOLDINGS


def standing_filings(filings: DataFrame) -> DataFrame:
    """The filings each filer's report for a period stands on, with the base each NEW HOLDINGS amendment adds to."""
    order = F.struct(F.coalesce(F.col("filed").cast("string"), F.lit("")).alias("d"), F.col("accession").alias("a"))
    ok = filings.where("checksum_ok").withColumns({"__o": order, "__adds": _adds()})
    base = ok.groupBy("manager", "filer", "period").agg(F.max(F.when(~F.col("__adds"), F.col("__o"))).alias("__base"))
    j = ok.join(base, ["manager", "filer", "period"]).where(F.col("__base").isNotNull())
    keep = (F.col("__o") == F.col("__base")) | (F.col("__adds") & (F.col("__o") > F.col("__base")))
    return j.where(keep).select("manager", "filer", "period", "accession", "filed",
                                F.when(F.col("__adds"), F.col("__base.a")).alias("base_accession"))


_REPEAT = ("cusip", "put_call", "shares", "value_usd")


def drop_repeated_rows(holdings: DataFrame, standing: DataFrame) -> DataFrame:
    """Holdings of the standing filings; an amendment's rows that repeat its base's are dropped one for one."""
    h = holdings.join(standing.select("accession", "base_accession", "manager", "filer", "period", "filed"), "accession")
    w = Window.partitionBy("accession", *_REPEAT).orderBy("row")
    amend = h.where(F.col("base_accession").isNotNull()).withColumn("__k", F.row_number().over(w))
    base = (holdings.join(standing.select(F.col("base_accession").alias("accession")).where(F.col("accession").isNotNull()).distinct(), "accession")
            .groupBy("accession", *_REPEAT).agg(F.count("*").alias("__n")))
    b = base.select(F.col("accession").alias("__ba"), *[F.col(c).alias(f"__{c}") for c in _REPEAT], "__n")
    cond = [F.col("base_accession") == F.col("__ba")] + [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in _REPEAT]
    fresh = amend.join(b, cond, "left").where(F.col("__n").isNull() | (F.col("__k") > F.col("__n")))
    return h.where(F.col("base_accession").isNull()).unionByName(fresh.select(*h.columns))


def positions(rows: DataFrame, cusip_map: DataFrame) -> DataFrame:
    """Summed shares and value per (manager, period, security, put/call), with CUSIPs, first issuer and weight."""
    m = cusip_map.where(F.col("ticker").isNotNull()).select("cusip", "ticker")
    j = rows.join(m, "cusip", "left").withColumns({
        "security": F.coalesce("ticker", "cusip"), "put_call": F.coalesce("put_call", F.lit("")),
        "__o": F.struct(F.col("filed").cast("string"), "accession", "row")})
    p = j.groupBy("manager", "period", "security", "put_call").agg(
        F.max("ticker").alias("ticker"), F.min_by("issuer", "__o").alias("issuer"),
        F.min_by("title_of_class", "__o").alias("title_of_class"), F.min_by("share_type", "__o").alias("share_type"),
        F.array_sort(F.collect_set("cusip")).alias("cusips"), F.sum(F.coalesce("shares", F.lit(0.0))).alias("shares"),
        F.sum(F.coalesce("value_usd", F.lit(0.0))).alias("value"))
    totals = p.groupBy("manager", "period").agg(F.sum("value").alias("__t"))
    return p.join(totals, ["manager", "period"]).withColumn("weight", F.col("value") / F.nullif(F.col("__t"), F.lit(0.0))).drop("__t")


def quarter_complete(filings: DataFrame, standing: DataFrame, clock: Column | None = None) -> DataFrame:
    """(manager, period, complete): every filer of the period stands, and none of the quarter before is still awaited.

    The data's own clock, its latest filing date, decides whether a deadline has passed.
    """
    reported = filings.where(F.col("period").isNotNull()).select("manager", "filer", "period").distinct()
    ok = standing.select("manager", "filer", "period").distinct().withColumn("__s", F.lit(1))
    fallen = (reported.join(ok, ["manager", "filer", "period"], "left").groupBy("manager", "period")
              .agg(F.max(F.col("__s").isNull()).alias("__fallen")))
    due = (reported.select("manager", "filer", next_quarter_end("period").alias("period"))
           .join(reported, ["manager", "filer", "period"], "left_anti").select("manager", "period").distinct().withColumn("__awaited", F.lit(True)))
    j = fallen.join(due, ["manager", "period"], "left")
    if clock is None:
        j = j.crossJoin(F.broadcast(filings.agg(F.max("filed").alias("__clock"))))  # one row
    else:
        j = j.withColumn("__clock", clock)
    passed = F.coalesce(F.col("__clock") > filing_deadline(F.col("period")), F.lit(False))
    return j.select("manager", "period", (~F.col("__fallen") & (F.col("__awaited").isNull() | passed)).alias("complete"))


def with_previous(pos: DataFrame, quarters: DataFrame) -> DataFrame:
    """Full outer join of each position with the quarter before's, where both quarters are complete."""
    done = quarters.where("complete").select("manager", "period")
    both = done.join(done.select("manager", next_quarter_end("period").alias("period")), ["manager", "period"])
    keys = ["manager", "period", "security", "put_call"]
    info = ("ticker", "issuer", "title_of_class", "share_type")
    now = pos.join(both, ["manager", "period"], "left_semi").select(*keys, *info, F.col("shares").alias("shares_after"), F.col("value").alias("value_after"))
    before = (pos.withColumn("period", next_quarter_end("period")).join(both, ["manager", "period"], "left_semi")
              .select(*keys, *[F.col(c).alias(f"__{c}") for c in info], F.col("shares").alias("shares_before"), F.col("value").alias("value_before")))
    j = now.join(before, keys, "full_outer")
    return j.select(*keys, *[F.coalesce(c, f"__{c}").alias(c) for c in info], "shares_before", "shares_after", "value_before", "value_after")


def nearest_split_ratio(ratio: Column) -> Column:
    """The listed forward ratio nearest by quotient."""
    return F.array_min(F.array(*[F.struct(F.abs(F.ln(ratio / r)).alias("gap"), F.lit(r).alias("r")) for r in SPLIT_RATIOS]))["r"]


def implied_splits(pairs: DataFrame, covered: DataFrame) -> DataFrame:
    """(security, period, implied): the forward split a security's holders show, for securities without split data."""
    s, v = F.col("shares_after"), F.col("value_after")
    held = (pairs.join(covered.select(F.col("ticker").alias("__c")).distinct(), F.col("ticker") == F.col("__c"), "left")
            .where(F.col("__c").isNull() & (F.col("put_call") == "") & (F.upper(F.coalesce("share_type", F.lit(""))) == "SH")
                   & (F.col("shares_before") > 0) & (s > 0) & (F.col("value_before") > 0) & (v > 0))
            .select("security", "period", (s / F.col("shares_before")).alias("__m"),
                    ((F.col("value_before") / F.col("shares_before")) / (v / s)).alias("__p")))
    held = held.withColumn("__r", nearest_split_ratio(F.col("__m")))
    fits = F.abs(F.col("__m") / F.col("__r") - 1.0) <= SPLIT_SHARES_TOLERANCE
    price = exact_percentiles(held, ["security", "period"], "__p", {"__price": 0.5})
    # At most one entry per listed ratio is collected.
    g = held.groupBy("security", "period").agg(
        F.max(F.abs(F.col("__m") - 1.0) <= SPLIT_SHARES_TOLERANCE).alias("__veto"),
        F.collect_set(F.when(fits, F.col("__r"))).alias("__rs")).where(~F.col("__veto") & (F.size("__rs") > 0)).join(price, ["security", "period"])
    good = F.filter("__rs", lambda r: F.greatest(F.col("__price") / r, r / F.col("__price")) <= SPLIT_PRICE_TOLERANCE)
    best = F.array_min(F.transform(good, lambda r: F.struct(F.abs(F.ln(F.col("__price") / r)).alias("gap"), r.alias("r"))))["r"]
    return g.select("security", "period", best.cast("double").alias("implied")).where(F.col("implied").isNotNull())


def quarter_changes(pairs: DataFrame, splits: DataFrame, implied: DataFrame) -> DataFrame:
    """Each position's action from the quarter before on its split basis, and its change in percent."""
    tick = pairs.where(F.col("ticker").isNotNull()).select("ticker", previous_quarter_end("period").alias("after"), F.col("period").alias("through")).distinct()
    factors = split_product(tick, splits.where(is_simple_ratio(F.col("ratio"))), "ticker").select("ticker", F.col("through").alias("period"), "factor")
    j = pairs.join(factors, ["ticker", "period"], "left").join(implied, ["security", "period"], "left")
    factor = F.when(F.col("shares_before").isNull(), 1.0).otherwise(F.coalesce("factor", F.lit(1.0)) * F.coalesce("implied", F.lit(1.0)))
    adjusted = F.col("shares_before") * factor
    after = F.col("shares_after")
    action = (F.when(F.col("shares_before").isNull(), "new").when(after.isNull(), "sold_out").when(after > adjusted, "added")
              .when(after < adjusted, "reduced").otherwise("unchanged"))
    return j.select("manager", "period", "security", "put_call", "ticker", "issuer", "shares_before", "shares_after", "value_before",
                    "value_after", factor.alias("split_factor"), action.alias("action"),
                    F.when(F.col("shares_before").isNotNull() & after.isNotNull(), (after - adjusted) / F.nullif(adjusted, F.lit(0.0))).alias("change_pct"))


def build_quarters(filings: DataFrame, holdings: DataFrame, cusip_map: DataFrame, splits: DataFrame, covered: DataFrame):
    """(quarters, positions, changes) of every manager and period from the filings and their rows."""
    standing = standing_filings(filings)
    pos = positions(drop_repeated_rows(holdings, standing), cusip_map)
    complete = quarter_complete(filings, standing)
    pairs = with_previous(pos, complete)
    changes = quarter_changes(pairs, splits, implied_splits(pairs, covered))
    totals = pos.groupBy("manager", "period").agg(F.sum("value").alias("total_value"))
    filed = standing.groupBy("manager", "period").agg(F.max("filed").alias("filed"))
    prior = pairs.select("manager", "period").distinct().withColumn("has_prior", F.lit(True))
    quarters = (complete.join(totals, ["manager", "period"], "left").join(filed, ["manager", "period"], "left")
                .join(prior, ["manager", "period"], "left").withColumn("has_prior", F.coalesce("has_prior", F.lit(False))))
    return quarters, pos, changes


US_EXCHANGES = ("UN", "UW", "UQ", "UR", "UA", "UP", "UV", "UF")


def pick_listing(listings: DataFrame) -> DataFrame:
    """One listing per CUSIP: the US composite, else the first US exchange, else the first, then without its ticker."""
    tier = F.when(F.col("exch_code") == "US", 0).when(F.col("exch_code").isin(*US_EXCHANGES), 1).otherwise(2)
    best = F.min_by(F.struct("ticker", "name", tier.alias("tier")), F.struct(tier.alias("t"), F.col("position")))
    return listings.groupBy("cusip").agg(best.alias("b")).select(
        "cusip", F.when(F.col("b.tier") < 2, F.replace(F.col("b.ticker"), F.lit("/"), F.lit("-"))).alias("ticker"), F.col("b.name").alias("name"))


def map_cusips(holdings: DataFrame, universe: DataFrame, listings: DataFrame) -> DataFrame:
    """(cusip, ticker, name, source): the universe's own codes first, then listings, else none.

    A code is named by the issuer most of its rows give (ties: the first alphabetically).
    """
    named = holdings.where(F.col("cusip").isNotNull()).groupBy("cusip", "issuer").agg(F.count("*").alias("n"))
    best = F.min_by("issuer", F.when(F.col("issuer").isNotNull(), F.struct((-F.col("n")).alias("a"), F.col("issuer").alias("b"))))
    c = named.groupBy("cusip").agg(best.alias("issuer"))
    u = universe.select("cusip", F.col("ticker").alias("__u"))
    f = pick_listing(listings).select("cusip", F.col("ticker").alias("__f"), F.col("name").alias("__n"), F.lit(1).alias("__hit"))
    j = c.join(u, "cusip", "left").join(f, "cusip", "left")
    source = F.when(F.col("__u").isNotNull(), "universe").when(F.col("__hit") == 1, "openfigi").otherwise("none")
    return j.select("cusip", F.when(source == "universe", F.col("__u")).otherwise(F.col("__f")).alias("ticker"),
                    F.when(source == "openfigi", F.col("__n")).otherwise(F.col("issuer")).alias("name"), source.alias("source"))


def share_classes(universe: DataFrame) -> DataFrame:
    """(ticker, class_ticker): tickers whose CUSIPs share an issuer (the first six characters), itself included.

    An issuer has a handful of classes, so the pairs of one issuer are few.
    """
    u = universe.select("ticker", F.substring("cusip", 1, 6).alias("issuer6")).distinct()
    return (u.join(u.select("issuer6", F.col("ticker").alias("class_ticker")), "issuer6").select("ticker", "class_ticker").distinct())


def latest_quarters(quarters: DataFrame) -> DataFrame:
    """Each manager's latest complete quarter, else its latest; current until the next report's deadline passes."""
    g = quarters.groupBy("manager").agg(F.coalesce(F.max(F.when(F.col("complete"), F.col("period"))), F.max("period")).alias("period"))
    clock = quarters.agg(F.max("filed").alias("__clock"))
    return (g.join(quarters.select("manager", "period", "complete"), ["manager", "period"]).crossJoin(F.broadcast(clock))
            .select("manager", "period", "complete", (filing_deadline(next_quarter_end("period")) >= F.col("__clock")).alias("current")))


def guru_list(quarters: DataFrame, pos: DataFrame, changes: DataFrame) -> DataFrame:
    """Each manager at its latest quarter with positions held, new and sold out (options apart)."""
    l = latest_quarters(quarters).select("manager", "period")
    held = pos.where(F.col("put_call") == "").join(l, ["manager", "period"]).groupBy("manager").agg(F.count("*").alias("positions"))
    c = changes.where(F.col("put_call") == "").join(l, ["manager", "period"]).groupBy("manager").agg(
        F.sum((F.col("action") == "new").cast("int")).alias("new"), F.sum((F.col("action") == "sold_out").cast("int")).alias("sold_out"))
    q = quarters.join(l, ["manager", "period"])
    return (q.join(held, "manager", "left").join(c, "manager", "left")
            .select("manager", "period", "filed", "total_value", "complete", "has_prior", F.coalesce("positions", F.lit(0)).cast("long").alias("positions"),
                    *[F.when(F.col("has_prior"), F.coalesce(F.col(x), F.lit(0))).cast("long").alias(x) for x in ("new", "sold_out")]))


def omits_holdings(filings: DataFrame, standing: DataFrame) -> DataFrame:
    """(manager, period, omitted): some filer's latest filing that speaks for the whole report states omitted holdings."""
    f = filings.join(standing.select("accession"), "accession", "left_semi")
    speaks = F.col("confidential_omitted").isNotNull() & ~(~F.col("confidential_omitted") & _adds())
    g = f.where(speaks).groupBy("manager", "period", "filer").agg(F.max_by("confidential_omitted", F.struct("filed", "accession")).alias("o"))
    return g.groupBy("manager", "period").agg(F.max("o").alias("omitted"))


def guru_view(pos: DataFrame, changes: DataFrame, manager, period: Column | None = None, quarters: DataFrame | None = None) -> DataFrame:
    """A manager's quarter: positions held with their action, and the positions it sold out."""
    p, c = pos.where(F.col("manager") == manager), changes.where(F.col("manager") == manager)
    if period is None:
        l = latest_quarters(quarters).where(F.col("manager") == manager).select("period")
        p, c = p.join(l, "period", "left_semi"), c.join(l, "period", "left_semi")
    else:
        p, c = p.where(F.col("period") == period), c.where(F.col("period") == period)
    keys = ["manager", "period", "security", "put_call"]
    return (p.select(*keys, "shares", "value", "weight").join(
        c.select(*keys, "action", "shares_before", "value_before", "split_factor", "change_pct"), keys, "full_outer"))


def gurus_holding(ticker: str, classes: DataFrame, pos: DataFrame, quarters: DataFrame) -> DataFrame:
    """Latest-quarter positions in a stock or its other share classes, the largest first."""
    wanted = classes.where(F.col("ticker") == ticker).select(F.col("class_ticker").alias("ticker"))
    l = latest_quarters(quarters).select("manager", "period")
    return (pos.join(wanted, "ticker", "left_semi").join(l, ["manager", "period"])
            .select("manager", "period", "ticker", "security", "put_call", "shares", "value", "weight")
            .orderBy(F.col("put_call") != "", F.desc("value"), "manager", "security", "put_call"))


def guru_portfolio(pos: DataFrame, changes: DataFrame, quarters: DataFrame, limit: int | None = None) -> DataFrame:
    """The aggregate of every manager's latest quarter: holders, shares, value, buyers, sellers; the most held first, *limit* of them if given."""
    l = latest_quarters(quarters).select("manager", "period")
    held = pos.where(F.col("put_call") == "").join(l, ["manager", "period"]).groupBy("security").agg(
        F.count("*").alias("gurus"), F.sum("shares").alias("shares"), F.sum("value").alias("value"),
        F.max_by("issuer", F.struct("value", -F.col("manager"))).alias("issuer"))
    c = changes.where(F.col("put_call") == "").join(l, ["manager", "period"]).groupBy("security").agg(
        F.sum(F.col("action").isin("new", "added").cast("int")).alias("buyers"), F.sum(F.col("action").isin("reduced", "sold_out").cast("int")).alias("sellers"))
    p = (held.join(c, "security", "left").select("security", "issuer", "gurus", "shares", "value",
         *[F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("buyers", "sellers")])
         .orderBy(F.desc("gurus"), F.desc("value"), "security"))
    return p if limit is None else p.limit(limit)
