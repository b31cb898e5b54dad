"""From long facts to one value per period (RES-3..6, 8..14, 21, 24, 25, 28) and point-in-time reads (PIT-1..8).

Winners are ``max_by`` aggregates over (priority, filing day), which combine before the shuffle; no
group of facts is ever sorted whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finstrata import registry as reg
from finstrata.functions.scale import asof_lookup
from finstrata.operators.periods import QUARTER_DAYS, YEAR_DAYS, fiscal_year_of
from finstrata.session import as_table

SAME_PERIOD_DAYS = 7
SPLIT_RATIO_TOLERANCE = 0.005
DEPOSIT_TAGS = ("Deposits", "InterestBearingDepositLiabilities", "DepositsTotal")


def candidates(facts: DataFrame, registry: DataFrame) -> DataFrame:
    """Facts joined with the fields their tag and unit may give, of the right kind (the registry's size is fixed)."""
    r = F.broadcast(registry)
    j = facts.join(r, ["tag", "unit"])
    return j.where(F.when(F.col("kind") == "instant", F.col("start").isNull()).otherwise(F.col("start").isNotNull()))


def annual_candidates(facts: DataFrame, registry: DataFrame) -> DataFrame:
    """Candidates from annual reports, with their fiscal year."""
    return _annual(candidates(facts, registry))


def _annual(c: DataFrame) -> DataFrame:
    span = F.datediff("end", "start")
    return (c.where(F.col("form").isin(*reg.ANNUAL_FORMS) & (F.col("start").isNull() | span.between(*YEAR_DAYS)))
            .withColumn("fiscal_year", fiscal_year_of("end")))


def year_ends(facts: DataFrame, registry: DataFrame) -> DataFrame:
    """(ticker, fiscal_year, year_end): the end most flow fields share, the later on a tie; else the latest end."""
    a = _annual(candidates(facts, registry))
    n = a.groupBy("ticker", "fiscal_year", "end").agg(F.countDistinct(F.when(F.col("start").isNotNull(), F.col("field"))).alias("n"))
    return n.groupBy("ticker", "fiscal_year").agg(F.max_by("end", F.struct("n", "end")).alias("year_end"))


def year_ends_by_filing(facts: DataFrame, registry: DataFrame) -> DataFrame:
    """(ticker, fiscal_year, filed, year_end): the same from the reports filed by each filing day.

    A field counts for an end from the first day it is filed, so the count on a day is a running sum of firsts.
    """
    a = _annual(candidates(facts, registry))
    firsts = a.groupBy("ticker", "fiscal_year", "end", "field").agg(
        F.min("filed").alias("filed"), F.min(F.when(F.col("start").isNotNull(), F.col("filed"))).alias("flow"))
    per = (firsts.groupBy("ticker", "fiscal_year", "end", "filed").agg(F.count("flow").alias("n")))
    days = a.select("ticker", "fiscal_year", "filed").distinct()
    ends = per.select("ticker", "fiscal_year", "end").distinct()
    # A fiscal year has one or two ends, so every day meets few.
    grid = days.join(ends, ["ticker", "fiscal_year"]).join(per, ["ticker", "fiscal_year", "end", "filed"], "left")
    w = Window.partitionBy("ticker", "fiscal_year", "end").orderBy("filed").rowsBetween(Window.unboundedPreceding, 0)
    run = grid.withColumns({"c": F.sum(F.coalesce("n", F.lit(0))).over(w), "seen": F.count("n").over(w)}).where(F.col("seen") > 0)
    return run.groupBy("ticker", "fiscal_year", "filed").agg(F.max_by("end", F.struct("c", "end")).alias("year_end"))


def resolve_canonical(c: DataFrame, keys: Sequence[str], set_aside: DataFrame | None = None, few: bool = False) -> DataFrame:
    """Long (keys, field, val, tag, accn, filed): the lowest tag priority, then the latest filed.

    *c*: ``candidates`` rows carrying *keys*; *set_aside* rows (keys subset + tag + field) rank after every tag. With *few*
    candidates a key, nothing is gained by combining before the shuffle: they meet as they are and are sorted once.
    """
    rank = F.col("priority")
    if set_aside is not None:
        on = [x for x in set_aside.columns]
        c = c.join(set_aside.withColumn("__aside", F.lit(1)), on, "left")
        rank = rank + F.when(F.col("__aside") == 1, F.col("n_tags")).otherwise(0)
    value = F.when(F.col("sign") == "abs", F.abs("val")).otherwise(F.col("val"))
    best = F.struct(-rank, F.col("filed").cast("date"), F.col("accn"), F.col("val"))  # no filing day ranks before any
    if few:
        c = c.withColumns({"__rank": -rank, "__val": value}).select(*keys, "field", "__rank", "__val", "filed", "accn", "val", "tag", "end", "form").repartition(*keys, "field")
        best, value = F.struct("__rank", F.col("filed").cast("date"), "accn", "val"), F.col("__val")
    return (c.groupBy(*keys, "field").agg(F.max_by(F.struct(value.alias("val"), "tag", "accn", "filed", "end", "form"), best).alias("b"))
            .select(*keys, "field", "b.*"))


def to_wide(resolved: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One column per field, with the tag and filing each value came from as maps."""
    v = resolved.groupBy(*keys).pivot("field", list(fields)).agg(F.max("val"))
    src = resolved.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "tag")))).alias("source_tags"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", F.struct("accn", "filed", "form").alias("f"))))).alias("source_filings"),
        F.max("filed").alias("filed_date"))
    return v.join(src, list(keys))


def _own_period(a: DataFrame, ends: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(ends, keys).where(F.abs(F.datediff("end", "year_end")) <= SAME_PERIOD_DAYS)


def annual_record(facts: DataFrame, registry: DataFrame, years: int | None = None, set_aside: DataFrame | None = None) -> DataFrame:
    """Long annual values from annual reports, each fiscal year's own period only."""
    a = _own_period(_annual(candidates(facts, registry)), year_ends(facts, registry), ["ticker", "fiscal_year"])
    r = resolve_canonical(a, ["ticker", "fiscal_year"], set_aside)
    if years is not None:
        last = r.groupBy("ticker").agg(F.max("fiscal_year").alias("__y"))
        r = r.join(last, "ticker").where(F.col("fiscal_year") > F.col("__y") - years).drop("__y")
    return r


def vintages(facts: DataFrame, registry: DataFrame) -> DataFrame:
    """The same values keyed additionally by filing."""
    a = _annual(candidates(facts, registry))
    a = _own_period(a, year_ends_by_filing(facts, registry), ["ticker", "fiscal_year", "filed"])
    return resolve_canonical(a.withColumn("filing", F.col("accn")), ["ticker", "fiscal_year", "filing"])


def instant_checkpoints(facts: DataFrame, registry: DataFrame) -> DataFrame:
    """Balance-sheet values of quarterly and annual reports, keyed by date."""
    c = candidates(facts.where(F.col("form").isin(*reg.QUARTERLY_FORMS)), registry).where(F.col("kind") == "instant")
    return resolve_canonical(c.withColumn("period_end", F.col("end")), ["ticker", "period_end"])


def rungs(facts: DataFrame, registry: DataFrame) -> DataFrame:
    """Year-to-date figures, one per (ticker, field, start, end): (rank, filed) winner."""
    c = candidates(facts.where(F.col("form").isin(*reg.QUARTERLY_FORMS)), registry).where(F.col("kind") == "duration")
    r = resolve_canonical(c.withColumns({"s": F.col("start"), "e": F.col("end")}), ["ticker", "s", "e"])
    return r.select("ticker", "field", F.col("s").alias("start"), F.col("e").alias("end"), "val", "form")


def discrete_quarters(ladder: DataFrame, registry: DataFrame) -> DataFrame:
    """Single quarters from cumulative rungs that share a start (a handful a year).

    A rung of quarter length is a quarter itself; two rungs a quarter apart give their difference. Magnitudes of
    outflows never shrink, net outflows by less than half; weighted counts are weighted by days and stay positive.
    """
    info = F.broadcast(registry.select("field", "sign", "unit").distinct())
    w = Window.partitionBy("ticker", "field", "start").orderBy("end")
    d = ladder.where(F.col("val").isNotNull()).join(info, "field").withColumns({"pv": F.lag("val").over(w), "pe": F.lag("end").over(w), "n": F.count("end").over(Window.partitionBy("ticker", "field", "start"))})
    days, pdays = F.datediff("end", "start") + 1, F.datediff("pe", "start") + 1
    own = F.datediff("end", "start").between(*QUARTER_DAYS)
    step = F.datediff("end", "pe").between(*QUARTER_DAYS)
    outflow = F.when(F.abs("val") >= F.abs("pv"), F.abs("val") - F.abs("pv"))
    net = F.when(~((F.col("pv") > 0) & (F.col("val") <= F.col("pv") / 2)), F.col("val") - F.col("pv"))
    count = (F.col("val") * days - F.col("pv") * pdays) / F.datediff("end", "pe")
    diff = (F.when(F.col("unit") == "shares", F.when(count > 0, count)).when(F.col("sign") == "abs", outflow)
            .when(F.col("sign") == "net", net).otherwise(F.col("val") - F.col("pv")))
    value = F.when(own, F.when(F.col("sign") == "abs", F.abs("val")).otherwise(F.col("val"))).when(step, diff)
    return (d.withColumn("value", value).where(F.col("value").isNotNull())
            .select("ticker", "field", "start", F.col("end").alias("period_end"), "value", (own & (F.col("n") == 1)).alias("lone")))


def quarters_of(quarters: DataFrame, periods: DataFrame) -> DataFrame:
    """Keeps a lone first-quarter figure only where the period has a balance sheet (*periods*: ticker, period_end)."""
    seen = periods.select("ticker", "period_end", F.lit(True).alias("__seen")).distinct()
    return quarters.join(seen, ["ticker", "period_end"], "left").where(F.when(F.col("lone"), F.col("__seen")).otherwise(~F.col("lone"))).select(*[c for c in quarters.columns if c != "lone"])


def ladder_year(ladder: DataFrame) -> DataFrame:
    """(ticker, start, fiscal_year, closed): a ladder closed by an annual report takes its end's year; an open one the
    year after the previous ladder's, by its start day."""
    g = ladder.groupBy("ticker", "start").agg(F.max(F.when(F.col("form").isin(*reg.ANNUAL_FORMS) & F.datediff("end", "start").between(*YEAR_DAYS), F.col("end"))).alias("closed_end"))
    w = Window.partitionBy("ticker").orderBy("start")
    prev = F.last(F.when(F.col("closed_end").isNotNull(), fiscal_year_of("closed_end")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    pend = F.last("closed_end", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.round(F.datediff("start", pend) / 365.25).cast("int")
    open_year = F.coalesce(prev + 1 + gap, fiscal_year_of(F.date_add("start", 364)))
    return g.select("ticker", "start", F.coalesce(fiscal_year_of("closed_end"), open_year).alias("fiscal_year"), F.col("closed_end").isNotNull().alias("closed"))


def split_restatements(facts: DataFrame, tags: Sequence[str], simple: "callable", min_windows: int = 2) -> DataFrame:
    """(ticker, ratio, after, through): share counts of one period that two filings state at a simple split ratio, where
    at least *min_windows* such windows overlap (gaps and islands per ratio)."""
    f = (facts.where(F.col("tag").isin(*tags) & (F.col("unit") == "shares") & (F.col("val") > 0))
         .groupBy("ticker", "tag", "start", "end", "filed").agg(F.max("val").alias("val")))
    w = Window.partitionBy("ticker", "tag", "start", "end").orderBy("filed")
    m = f.withColumns({"pv": F.lag("val").over(w), "after": F.lag("filed").over(w)}).where(F.col("pv").isNotNull())
    raw = F.col("val") / F.col("pv")
    near = F.when(raw >= 1, F.round(raw * 2) / 2).otherwise(2 / F.round(2 / raw))
    m = m.withColumn("ratio", near).where((F.abs(raw / near - 1) <= SPLIT_RATIO_TOLERANCE) & simple(F.col("ratio")) & (F.col("ratio") != 1))
    m = m.select("ticker", "ratio", "after", F.col("filed").alias("through")).distinct()
    ww = Window.partitionBy("ticker", "ratio").orderBy("after", "through")
    top = F.max("through").over(ww.rowsBetween(Window.unboundedPreceding, -1))
    isl = m.withColumn("__new", F.coalesce(F.col("after") >= top, F.lit(True)).cast("int")).withColumn("__g", F.sum("__new").over(ww))
    g = isl.groupBy("ticker", "ratio", "__g").agg(F.max("after").alias("after"), F.min("through").alias("through"), F.count("*").alias("windows"))
    return g.where(F.col("windows") >= min_windows).drop("__g")


def validate_rows(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Casts each column to its type; a value that will not cast is kept as text in ``validation_errors``."""
    bad = F.array_compact(F.array(*[F.when(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull(), F.concat(F.lit(f"{c}: not a {t}: "), F.col(c).cast("string")))
                                    for c, t in types.items()]))
    return df.withColumn("validation_errors", bad).withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})


def classify_sector(companies: DataFrame, facts: DataFrame) -> DataFrame:
    """(ticker, sector_class) from the SIC code; the bank range needs deposits among the company's facts."""
    code = F.col("sic").try_cast("int")
    raw = (F.when(code.between(6020, 6299) | (code == 6712), "bank").when(code.between(6300, 6411) & (code != 6324), "insurance")
           .when(code == 6798, "reit").when(code.between(4900, 4991), "utility").when(code.between(1300, 1399) | (code == 2911), "energy").otherwise("general"))
    dep = facts.where(F.col("tag").isin(*DEPOSIT_TAGS)).select("ticker").distinct().withColumn("__d", F.lit(True))
    j = companies.join(dep, "ticker", "left")
    return j.select("ticker", F.when((raw == "bank") & F.col("__d").isNull(), "general").otherwise(raw).alias("sector_class"))


# ---- as-of snapshots

def changed_days(facts: DataFrame, registry: DataFrame) -> DataFrame:
    """(ticker, day): filing days that can change the record: those of annual facts under mapped tags."""
    return _annual(candidates(facts, registry)).select("ticker", F.col("filed").alias("day")).distinct()


# ---- point in time

def as_of_annual(known: DataFrame, probes: DataFrame) -> DataFrame:
    """Each probe (ticker, fiscal_year, day) with the row known then; none where the year had left the record."""
    payload = [c for c in known.columns if c not in ("ticker", "fiscal_year", "known_from")]
    j = asof_lookup(probes, known, ["ticker", "fiscal_year"], "day", "known_from", payload)
    return j.withColumnRenamed("known_from_found", "known_from").where(F.col("present"))


def as_of_value(known: DataFrame, probes: DataFrame, field: str) -> DataFrame:
    return as_of_annual(known.select("ticker", "fiscal_year", "known_from", "present", field), probes).select("ticker", "fiscal_year", "day", field)


def history_as_of(known: DataFrame, probes: DataFrame, years: int | None = None) -> DataFrame:
    """Every fiscal year in the record on each probe's (ticker, day), newest first, the latest *years*."""
    grid = probes.join(known.select("ticker", "fiscal_year").distinct(), "ticker")
    h = as_of_annual(known, grid)
    if years is None:
        return h
    w = Window.partitionBy("ticker", "day").orderBy(F.desc("fiscal_year"))
    return h.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= years).drop("__k")


def carried_from(known: DataFrame) -> DataFrame:
    """Adds ``carried``: the figures read from another filing than the row's own."""
    return known.withColumn("carried", F.map_filter("source_filings", lambda k, v: v["accn"] != F.col("accn")))


def has_snapshots(known: DataFrame, companies: DataFrame) -> DataFrame:
    """(ticker, has_snapshots): an unbuilt company differs from one with nothing filed."""
    k = known.select("ticker").distinct().withColumn("__h", F.lit(True))
    return companies.select("ticker").join(k, "ticker", "left").select("ticker", F.coalesce("__h", F.lit(False)).alias("has_snapshots"))


def list_vintages(vintage_rows: DataFrame, fiscal_year: int | None = None) -> DataFrame:
    v = vintage_rows if fiscal_year is None else vintage_rows.where(F.col("fiscal_year") == fiscal_year)
    return v.orderBy("ticker", F.desc("fiscal_year"), "filed")


# ---- tagging errors of later filings (RES-7)

# Totals never zero, the least power of ten read as a scale error, years around that decide.
NEVER_ZERO = ("total_assets", "current_assets", "total_liabilities", "current_liabilities", "total_equity")
MIN_SCALE_ERROR, NEIGHBOUR_YEARS, COUNT_TOLERANCE = 3, 2, 0.1
CASH_SECTIONS = ("operating_cash_flow", "investing_cash_flow", "financing_cash_flow")
WEIGHTED_COUNTS = ("weighted_avg_shares_basic", "weighted_avg_shares_diluted")


def _error_kind(earlier: Column, latest: Column, field: Column) -> Column:
    """sign flip, zero or scale: what a later figure is of the one earlier filings agree on; NULL when no such error."""
    from finstrata.operators.facts import agree
    ratio = latest / F.nullif(earlier, F.lit(0.0))
    k = F.round(F.log10(F.when(ratio > 0, ratio))).cast("int")
    scale = (F.abs(k) >= MIN_SCALE_ERROR) & agree(ratio, F.pow(F.lit(10.0), k.cast("double")))
    return (F.when((earlier == 0) | agree(earlier, latest), None).when(latest == 0, F.when(field.isin(*NEVER_ZERO), "zero"))
            .when(agree(earlier, -latest), "sign flip").when(scale, F.concat(F.lit("scale x10^"), k.cast("string"))))


def restore_agreed_figures(record: DataFrame, facts: DataFrame, registry: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """The long annual record with figures put back where the latest filing's reads as a tagging error.

    A year's own net change in cash decides for its cash-flow sections, its shares outstanding for a weighted count
    in thousands, and the years around it for the rest. Adds ``repair`` (the kind) where a figure was put back. Only
    a year's annual reports under the winning tag are listed: a handful. *ends*: :func:`year_ends` of the facts, if at hand.
    """
    from finstrata.functions.exprs import array_median
    from finstrata.operators.facts import agree
    key = ["ticker", "fiscal_year", "field"]
    a = _own_period(_annual(candidates(facts, registry)), year_ends(facts, registry) if ends is None else ends, ["ticker", "fiscal_year"])
    value = F.when(F.col("sign") == "abs", F.abs("val")).otherwise(F.col("val"))
    won = record.select(*key, "tag", F.col("val").alias("latest"))
    h = (a.join(won, [*key, "tag"]).groupBy(*key, "latest")
         .agg(F.array_sort(F.collect_set(F.struct("filed", value.alias("v"), "accn"))).alias("h")))
    last = F.element_at("h", -1)["filed"]
    same, before = F.filter("h", lambda x: x["filed"] == last), F.filter("h", lambda x: x["filed"] < last)
    h = h.withColumns({"__before": before, "__ok": F.forall(same, lambda x: agree(x["v"], F.col("latest")))})
    h = h.withColumn("earlier", F.get("__before", F.size("__before") - 1)["v"])
    h = h.where(F.col("__ok") & (F.size("__before") > 0) & F.forall("__before", lambda x: agree(x["v"], F.col("earlier"))))
    h = h.withColumns({"kind": _error_kind(F.col("earlier"), F.col("latest"), F.col("field")), "kept_from": F.get("__before", F.size("__before") - 1)["accn"]})
    # Few, and read twice below.
    conflicts = as_table(h.where(F.col("kind").isNotNull()).select(*key, "earlier", "latest", "kind", "kept_from"), "conflicts")
    w = Window.partitionBy("ticker", "field").orderBy("fiscal_year")
    around = record.select(*key, F.concat(F.collect_list("val").over(w.rangeBetween(-NEIGHBOUR_YEARS, -1)), F.collect_list("val").over(w.rangeBetween(1, NEIGHBOUR_YEARS))).alias("near"))
    year = record.join(conflicts.select(*key, "earlier"), key, "left")
    pick = lambda f, c, n: F.max(F.when(F.col("field") == f, F.col(c))).alias(n)
    cash = year.groupBy("ticker", "fiscal_year").agg(
        *[pick(s, "val", f"c{i}") for i, s in enumerate(CASH_SECTIONS)], *[pick(s, "earlier", f"e{i}") for i, s in enumerate(CASH_SECTIONS)],
        pick("net_change_in_cash", "val", "net"), pick("fx_effect_on_cash", "val", "fx"), pick("cash_from_discontinued_operations", "val", "disc"), pick("shares_outstanding", "val", "out"))

    def adds_up(parts: list[Column]) -> Column:
        total, top = parts[0] + parts[1] + parts[2], F.greatest(*[F.abs(p) for p in parts])
        room = 0.01 * F.when(top == 0, 1.0).otherwise(top)
        fx, disc = F.coalesce("fx", F.lit(0.0)), F.coalesce("disc", F.lit(0.0))
        hit = F.lit(False)
        for extra in (F.lit(0.0), fx, disc, fx + disc):
            hit = hit | (F.abs(total + extra - F.col("net")) <= room)
        return hit

    now = [F.col(f"c{i}") for i in range(3)]
    agreed = [F.coalesce(f"e{i}", f"c{i}") for i in range(3)]
    j = conflicts.join(around, key).join(cash, ["ticker", "fiscal_year"])
    logs = F.transform(F.filter("near", lambda v: v != 0), lambda v: F.log10(F.abs(v)))
    j = j.withColumn("__mid", array_median(logs)).withColumn("__logs", F.size(logs))
    e, l, near = F.col("earlier"), F.col("latest"), F.col("near")
    far = (F.abs(F.log10(F.abs(F.nullif(e, F.lit(0.0)))) - F.col("__mid")) <= 1) & ((l == 0) | (F.abs(F.log10(F.abs(F.nullif(l, F.lit(0.0)))) - F.col("__mid")) > 1))
    years = (F.size(near) >= 2) & F.when(F.col("kind") == "sign flip", F.forall(near, lambda v: (v != 0) & ((v > 0) == (e > 0)))).otherwise(
        ~((F.col("kind") == "zero") & F.exists(near, lambda v: v == 0)) & (F.col("__logs") >= 2) & far)
    judged = F.col("field").isin(*CASH_SECTIONS) & (now[0] + now[1] + now[2] + F.col("net")).isNotNull()
    counted = F.col("field").isin(*WEIGHTED_COUNTS) & F.col("kind").startswith("scale x10^-") & (F.col("out") > 0) & (F.abs(e / F.nullif(F.col("out"), F.lit(0.0)) - 1) <= COUNT_TOLERANCE)
    put_back = F.when(judged, ~adds_up(now) & adds_up(agreed)).otherwise(F.coalesce(counted, F.lit(False)) | F.coalesce(years, F.lit(False)))
    fixed = j.where(put_back).select(*key, "earlier", "kind", "kept_from")
    return (record.join(fixed, key, "left").withColumns({"val": F.coalesce("earlier", "val"), "accn": F.coalesce("kept_from", "accn")})
            .withColumnRenamed("kind", "repair").drop("earlier", "kept_from"))
