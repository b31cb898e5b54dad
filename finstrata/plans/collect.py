"""From raw facts to the annual, quarterly and trailing-year records and the vintages.

Cleaning rules touch few tags each. Facts are split by the family of tags that rules own, a family's rules run over
its own small share of the facts in order, and all other facts pass by them: no rule joins the whole table but the one
on filings' currency. What each rule did is its family's before and after, kept as a log of effects. A rule looks at
its input many times over, so a family's facts are checkpointed after each rule; else plans would multiply.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finstrata import registry as reg
from finstrata.operators import current_debt as cd
from finstrata.operators import depreciation as dp
from finstrata.operators import displaced, ladders, periods
from finstrata.operators import facts as fx
from finstrata.operators import resolve as rs
from finstrata.operators import split_series as ss
from finstrata.operators import splits as sp
from finstrata.session import as_table

Step = Callable[[DataFrame, str], DataFrame]
_FACT = ["ticker", "accn", "tag", "unit", "start", "end", "val", "filed", "form"]
_YEAR = ["ticker", "fiscal_year"]
#: The units of flows and counts that a split restates, and the weighted counts with the figures that check them.
_COUNTS = [f for f in reg.FIELDS if reg.UNIT[f] == "shares"]
_PER_SHARE = [f for f in reg.FIELDS if reg.UNIT[f] == "USD/shares"]
_CHECKED = {"weighted_avg_shares_basic": "eps_basic", "weighted_avg_shares_diluted": "eps_diluted"}


def _plain(rule: Callable[[DataFrame], DataFrame]) -> Step:
    return lambda facts, view: rule(facts)


def _current_debt(facts: DataFrame, view: str) -> DataFrame:
    """Judged on the facts as they come; a figure set aside is so before the combinations enter."""
    judged = cd.current_debt_combinations(facts, view)
    return cd.current_debt_combined(cd.current_debt_set_aside(facts, view, judged[0]), view, judged)


@dataclass(frozen=True)
class Family:
    """Rules over the tags they may change (*owns*) and those they only look at (*reads*, or tags beginning so)."""

    name: str
    owns: tuple[str, ...]
    reads: tuple[str, ...]
    rules: tuple[tuple[str, Step], ...]
    beginnings: tuple[str, ...] = ()

    def part(self, facts: DataFrame) -> DataFrame:
        wanted = F.col("tag").isin(*self.owns, *self.reads)
        for b in self.beginnings:
            wanted = wanted | F.col("tag").startswith(b)
        return facts.where(wanted)


def _settled(df: DataFrame) -> DataFrame:
    """*df* as a table in the checkpoint folder: what is read many times over is planned and computed once."""
    return as_table(df, "collect")


def _after(rule: Step, part: DataFrame, view: str) -> DataFrame:
    return _settled(rule(part, view))


def _tags(sign: str) -> tuple[str, ...]:
    return tuple(t for f in reg.FIELDS if reg.SIGN[f] == sign for t in reg.TAGS[f])


FAMILIES = (
    Family("cash", (fx.RESTRICTED_CASH, fx.CASH), (fx.BALANCE_TOTAL, fx.CASH_EQUIVALENTS, *fx.CASH_LINES), (
        ("balance-sheet dates", _plain(fx.balance_sheet_dates_only)), ("restricted total made up", _plain(fx.cash_totals_set_aside)), ("cash a part", _plain(fx.cash_parts_set_aside))),
        ("Restricted", "DepositsAssets")),
    Family("outflows", _tags("net"), _tags("abs"), (("net outflows as paid", _plain(fx.net_outflows_as_paid)),)),
    Family("debt", tuple(dict.fromkeys((*reg.TAGS["long_term_debt"], cd.DEBT, cd.PAPER, *fx.MATURITIES))),
           (fx.BALANCE_TOTAL, "Assets", fx.NEXT_MATURITIES, cd.REFINANCED, *fx.DEBT_LINES, *cd._NAMES), (
        ("balance-sheet dates", _plain(fx.balance_sheet_dates_only)), ("debt dates", _plain(fx.debt_on_balance_sheet_dates)), ("debt a part", _plain(fx.debt_parts_set_aside)),
        ("debt total held", _plain(fx.debt_totals_set_aside)), ("current debt", _current_debt))),
    Family("depreciation", tuple(displaced.TOTALS), (displaced.DEPRECIATION, *displaced.AMORTIZATION, *reg.TAGS["revenue"]), (
        ("total displaced", _plain(displaced.da_totals_displaced)), ("depreciation combined", _plain(dp.depreciation_combined)))),
)


def clean_facts(facts: DataFrame, view: str = "annual") -> DataFrame:
    """The facts as the records of *view* (annual, quarterly or vintage) read them."""
    facts = facts.select(_FACT)
    # Every family asks which filings are foreign; they are told once.
    facts = facts.join(_settled(fx.foreign_filings(facts)), fx.FILING, "left_anti")
    owned = [t for f in FAMILIES for t in f.owns]
    out = facts.where(~F.col("tag").isin(*owned))
    for family in FAMILIES:
        part = _settled(family.part(facts))
        for _, rule in family.rules:
            part = _after(rule, part, view)
        out = out.unionByName(part.where(F.col("tag").isin(*family.owns)).select(_FACT))
    return out


def effects(facts: DataFrame, view: str = "annual") -> DataFrame:
    """(rule, action, fact...): what each rule set aside (``out``) and entered (``in``), in the order of rules."""
    facts = facts.select(_FACT)
    dollars = fx.drop_foreign_filings(facts)
    log = facts.exceptAll(dollars).select(F.lit("foreign filing").alias("rule"), F.lit("out").alias("action"), *_FACT)
    for family in FAMILIES:
        before = family.part(dollars).where(F.col("tag").isin(*family.owns))
        part = family.part(dollars)
        for name, rule in family.rules:
            part = _after(rule, part, view)
            after = part.where(F.col("tag").isin(*family.owns)).select(_FACT)
            for action, rows in (("out", before.exceptAll(after)), ("in", after.exceptAll(before))):
                log = log.unionByName(rows.select(F.lit(name).alias("rule"), F.lit(action).alias("action"), *_FACT))
            before = after
    return log


_READ_AS = [*fx.PERIOD, "tag", "field"]


@dataclass(frozen=True)
class Judged:
    """What the facts say of figures that records read otherwise, as tables that all records of the facts share."""

    unread: DataFrame
    revenue: DataFrame
    common: DataFrame

    @classmethod
    def of(cls, facts: DataFrame) -> Judged:
        contradicted = fx.to_common_contradicted(facts).withColumns({"tag": F.lit(fx.TO_COMMON), "field": F.lit("net_income_to_common")})
        part = fx.bank_revenue_parts(facts).withColumn("field", F.lit("revenue"))
        common = fx.to_common_set_aside(facts).withColumns({"tag": F.lit(fx.TO_COMMON), "field": F.lit("net_income")})
        return cls(_settled(contradicted.unionByName(part).distinct()), _settled(fx.revenue_set_aside(facts).withColumn("field", F.lit("revenue"))), _settled(common.select(_READ_AS)))

    def read(self, candidates: DataFrame) -> DataFrame:
        """Candidates that their fields read: no to-common figure its EPS contradicts, no part of a bank's revenue."""
        return candidates.join(self.unread, _READ_AS, "left_anti")

    def ranked_last(self, candidates: DataFrame) -> DataFrame:
        """Figures that are read after all others: revenue that isn't its year's, net income that isn't to common."""
        years = candidates.where(F.col("start").isNotNull()).select(*_READ_AS, periods.fiscal_year_of("end").alias("fiscal_year"))
        revenue = years.join(self.revenue, [*_YEAR, "tag", "field"]).select(_READ_AS)
        return _settled(revenue.unionByName(self.common).distinct())


def _cleaned(wide: DataFrame, order: str) -> DataFrame:
    """Share counts on one scale, then gaps filled by identities."""
    return periods.derive_identities(ss.normalize_share_scale(_settled(wide), order).drop("rescaled"), F.col("source_tags")["total_equity"])


def _annual_long(clean: DataFrame, registry: DataFrame, judged: Judged) -> tuple[DataFrame, DataFrame]:
    """The long annual record, tagging errors put right, and the years' ends."""
    ends = _settled(rs.year_ends(clean, registry))
    read = judged.read(rs.annual_candidates(clean, registry))
    own = _settled(read.join(ends, _YEAR).where(F.abs(F.datediff("end", "year_end")) <= rs.SAME_PERIOD_DAYS))
    long = _settled(rs.resolve_canonical(own, _YEAR, judged.ranked_last(own), few=True))
    return _settled(rs.restore_agreed_figures(long, clean, registry, ends)), ends


def annual_record(facts: DataFrame, registry: DataFrame, fields: Sequence[str] | None = None, clean: DataFrame | None = None) -> DataFrame:
    """A row a fiscal year that has ended by the company's latest filing: ``ticker, fiscal_year, period_end,
    calendar_year``, all fields, ``source_tags``, ``source_filings``, ``derived`` and ``repaired`` (figures put back).

    *clean*, here and below: :func:`clean_facts` of the view as a stored table, which spares planning it for every use.
    """
    fields = list(fields or reg.FIELDS)
    clean = clean_facts(facts, "annual") if clean is None else clean
    long, ends = _annual_long(clean, registry, Judged.of(clean))
    wide = rs.to_wide(long, _YEAR, fields)
    repaired = long.where(F.col("repair").isNotNull()).groupBy(*_YEAR).agg(F.array_sort(F.collect_list("field")).alias("repaired"))
    wide = wide.join(ends.withColumnRenamed("year_end", "period_end"), _YEAR).join(repaired, _YEAR, "left")
    wide = _cleaned(periods.ended_years(wide, facts), "fiscal_year")
    return wide.withColumn("calendar_year", periods.calendar_year_by_rule("period_end"))


def vintage_views(facts: DataFrame, registry: DataFrame, fields: Sequence[str] | None = None, clean: DataFrame | None = None) -> DataFrame:
    """Each annual report's own view of the years over on its day: ``ticker, fiscal_year, accn, filed_date`` and all fields.

    A view takes a count's scale from its own EPS, else from the year's views filed by its day, never from a later one
    or another year. A year has a handful of views, each repeated for the later ones' days.
    """
    fields = list(fields or reg.FIELDS)
    clean = clean_facts(facts, "vintage") if clean is None else clean
    judged = Judged.of(clean)
    read = judged.read(rs.annual_candidates(clean, registry))
    own = _settled(read.join(rs.year_ends_by_filing(clean, registry), [*_YEAR, "filed"]).where(F.abs(F.datediff("end", "year_end")) <= rs.SAME_PERIOD_DAYS))
    keys = [*_YEAR, "filing", "year_end"]
    long = rs.resolve_canonical(own.withColumn("filing", F.col("accn")), keys, judged.ranked_last(own), few=True)
    views = rs.to_wide(_settled(long), keys, fields).where(F.col("year_end") <= F.col("filed_date"))
    days = views.select(*_YEAR, F.col("filed_date").alias("day")).distinct()
    known = views.join(days, _YEAR).where(F.col("filed_date") <= F.col("day"))
    known = known.withColumns({"of": F.col("ticker"), "ticker": F.struct("ticker", "fiscal_year", "day")})
    scaled = ss.normalize_share_scale(_settled(known), "filed_date", neighbours=False).drop("rescaled").where(F.col("filed_date") == F.col("day"))
    out = periods.derive_identities(scaled.withColumn("ticker", F.col("of")).drop("of", "day"), F.col("source_tags")["total_equity"])
    return out.withColumnsRenamed({"filing": "accn", "year_end": "period_end"})


def _scaled_counts(rungs: DataFrame) -> DataFrame:
    """The rungs with their weighted counts on one scale within a year."""
    out = rungs.where(~F.col("field").isin(*_CHECKED))
    key = ["ticker", "start", "end"]
    figure = lambda f: rungs.where(F.col("field") == f).select(*key, "val")
    for count, eps in _CHECKED.items():
        fixed = ladders.rungs_on_one_scale(figure(count), figure("net_income"), figure(eps)).withColumnRenamed("val", "scaled")
        own = rungs.where(F.col("field") == count).join(fixed, key).withColumn("val", F.col("scaled")).drop("scaled")
        out = out.unionByName(own)
    return out


def quarterly_record(facts: DataFrame, registry: DataFrame, fields: Sequence[str] | None = None, clean: DataFrame | None = None) -> DataFrame:
    """A row a quarter end: ``ticker, period_end, fiscal_year, fiscal_quarter`` and all fields, flows of the three months.

    Flows are differences of figures to date, on their year's split basis and scale; balance-sheet figures are those
    filed for the date. Long-term debt that a report names otherwise is its line's. Ends inside a quarter are dropped.
    """
    fields = list(fields or reg.FIELDS)
    clean = clean_facts(facts, "quarterly") if clean is None else clean
    judged = Judged.of(clean)
    long_annual, ends = _annual_long(clean, registry, judged)
    put_back = long_annual.where(F.col("repair").isNotNull()).join(ends, _YEAR).select("ticker", "field", F.col("year_end").alias("e"), F.col("val").alias("kept"))
    filed = _settled(judged.read(rs.candidates(clean.where(F.col("form").isin(*reg.QUARTERLY_FORMS)), registry)))
    flows = filed.where(F.col("kind") == "duration").withColumns({"s": F.col("start"), "e": F.col("end")})
    won = rs.resolve_canonical(flows, ["ticker", "s", "e"], judged.ranked_last(filed), few=True)
    # a year's figure that the annual record puts back is read the same here
    year = F.datediff("e", "s") >= periods.YEAR_DAYS[0]
    won = won.join(put_back, ["ticker", "field", "e"], "left").withColumn("val", F.when(year, F.coalesce("kept", "val")).otherwise(F.col("val")))
    rungs = _settled(won.select("ticker", "field", F.col("s").alias("start"), F.col("e").alias("end"), "val", "form", "filed"))
    restated = _settled(rs.split_restatements(clean, [t for f in _COUNTS for t in reg.TAGS[f]], sp.is_simple_ratio))
    moved = ladders.rungs_on_year_basis(rungs.where(F.col("field").isin(*_COUNTS, *_PER_SHARE)).withColumn("is_count", F.col("field").isin(*_COUNTS)), restated)
    rungs = _settled(rungs.where(~F.col("field").isin(*_COUNTS, *_PER_SHARE)).unionByName(moved.select(*rungs.columns)))
    rungs = _settled(_scaled_counts(rungs))
    instants = rs.resolve_canonical(filed.where(F.col("kind") == "instant").withColumn("period_end", F.col("end")), ["ticker", "period_end"], few=True)
    instants = _settled(instants).join(put_back.withColumnRenamed("e", "period_end"), ["ticker", "field", "period_end"], "left").withColumn("val", F.coalesce("kept", "val"))
    counts = instants.where(F.col("field").isin(*_COUNTS)).withColumn("fiscal_year", periods.fiscal_year_of("period_end")).select("ticker", "field", "fiscal_year", F.col("period_end").alias("end"), "filed", "val", "tag")
    counts = ladders.instants_on_year_basis(counts, restated).select("ticker", "field", F.col("end").alias("period_end"), "val", "tag")
    points = instants.where(~F.col("field").isin(*_COUNTS)).select("ticker", "field", "period_end", "val", "tag").unionByName(counts)
    points = _settled(points)
    single = rs.quarters_of(rs.discrete_quarters(rungs, registry), points).select("ticker", "field", "period_end", F.col("value").alias("val"), F.lit(None).cast("string").alias("tag"))
    long = _settled(points.unionByName(single))
    tags = F.collect_set(F.when(F.col("tag").isNotNull(), F.struct("field", "tag")))
    wide = long.repartition("ticker", "period_end").groupBy("ticker", "period_end").agg(*[F.max(F.when(F.col("field") == f, F.col("val"))).alias(f) for f in fields], tags.alias("__tags"))
    told = (F.size("__tags") > 0) & F.col("ticker").isNotNull() & F.col("period_end").isNotNull()
    wide = wide.withColumn("source_tags", F.when(told, F.map_from_entries(F.array_sort("__tags")))).drop("__tags")
    ladder = rs.ladder_year(rungs).join(rungs.select("ticker", "start", F.col("end").alias("period_end")).distinct(), ["ticker", "start"])
    of = F.struct(F.datediff("period_end", "start"), F.col("start"))  # the longest period to date that ends there
    labels = ladder.groupBy("ticker", "period_end").agg(F.max_by("fiscal_year", of).alias("fiscal_year"), F.max_by(F.round(F.datediff("period_end", "start") / 91.3).cast("int"), of).alias("fiscal_quarter"))
    wide = wide.join(labels, ["ticker", "period_end"], "left")
    wide = _settled(wide)
    debt = long_annual.where(F.col("field") == "long_term_debt").join(ends, _YEAR).select("ticker", F.col("year_end").alias("period_end"), F.col("val").alias("long_term_debt"), "tag")
    lines = ladders.quarter_debt_lines(clean, debt, wide).select("ticker", "period_end", F.col("long_term_debt").alias("line"))
    wide = wide.join(lines, ["ticker", "period_end"], "left").withColumn("long_term_debt", F.coalesce("long_term_debt", "line")).drop("line")
    flows_in_dollars = [f for f in fields if reg.UNIT[f] == "USD" and reg.KIND[f] == "duration"]
    return _cleaned(periods.drop_inside_quarter(wide, flows_in_dollars), "period_end")


def ttm_record(quarterly: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """Trailing years of :func:`quarterly_record`'s rows."""
    fields = list(fields or reg.FIELDS)
    flow = lambda unit: [f for f in fields if reg.KIND[f] == "duration" and reg.UNIT[f] == unit]
    return periods.compute_ttm(quarterly, flow("USD"), [f for f in fields if reg.KIND[f] == "instant"], flow("shares"), flow("USD/shares"))
