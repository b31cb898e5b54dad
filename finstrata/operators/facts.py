"""Cleaning rules over long raw facts (FCT-1..8, 14..21, 23).

A fact is (ticker, tag, unit, start, end, val, accn, form, filed). Rules drop or rewrite rows by semi,
anti and keyed joins on (ticker, filing, date), so a company with many facts is spread by filing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finstrata import registry as reg
from finstrata.session import as_table

# Tags and tolerances of the rules.
AGREE = 0.005
RESTRICTED_CASH = "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents"
CASH_EQUIVALENTS, CASH = "CashEquivalentsAtCarryingValue", "Cash"
CASH_LINES = ("CashAndCashEquivalentsAtCarryingValue", "CashCashEquivalentsAndShortTermInvestments",
              "CashAndCashEquivalentsFairValueDisclosure")
BALANCE_SHEET_ONLY = (RESTRICTED_CASH, "CommercialPaper")
BALANCE_TOTAL = "LiabilitiesAndStockholdersEquity"
DEBT_KINDS = (("LongTermDebtNoncurrent", "LongTermDebtAndCapitalLeaseObligations", "LongTermNotesPayable",
               "UnsecuredLongTermDebt", "ConvertibleLongTermNotesPayable"), ("LongTermDebt", "NotesPayable"))
TO_COMMON = "NetIncomeLossAvailableToCommonStockholdersBasic"
EPS_PAIRS = (("eps_basic", "weighted_avg_shares_basic"), ("eps_diluted", "weighted_avg_shares_diluted"))
SCALES = (1e-6, 1e-3, 1.0, 1e3, 1e6)
SCALE_TOLERANCE, MIN_CHECKING_EPS, BANK_REVENUE_SHARE, REVENUE_GAP, PART = 0.1, 0.10, 0.8, 1.25, 0.5
WITH_TAXES = "RevenueFromContractWithCustomerIncludingAssessedTax"
REPORT_FORMS = ("10-K", "10-Q", "20-F", "40-F")
FILING = ["ticker", "accn"]
DATED = ["ticker", "accn", "end"]
PERIOD = ["ticker", "accn", "start", "end"]


def agree(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= AGREE * F.greatest(F.abs(a), F.abs(b))


def _currency() -> Column:
    return F.col("unit").rlike("^[A-Z]{3}$")


def reporting_currency(facts: DataFrame) -> DataFrame:
    """(ticker, currency): the currency most of the filer's monetary facts are in."""
    n = facts.where(_currency()).groupBy("ticker", "unit").count()
    return n.groupBy("ticker").agg(F.max_by("unit", F.struct("count", "unit")).alias("currency"))


def foreign_filings(facts: DataFrame) -> DataFrame:
    """(ticker, accn): filings with no more dollar facts than facts of another currency."""
    n = facts.where(_currency()).groupBy(*FILING, "unit").count()
    g = n.groupBy(*FILING).agg(F.coalesce(F.max(F.when(F.col("unit") == "USD", F.col("count"))), F.lit(0)).alias("usd"),
                               F.max(F.when(F.col("unit") != "USD", F.col("count"))).alias("other"))
    return g.where(F.col("usd") <= F.col("other")).select(*FILING)


def drop_foreign_filings(facts: DataFrame) -> DataFrame:
    return facts.join(foreign_filings(facts), FILING, "left_anti")


def balance_sheet_dates_only(facts: DataFrame) -> DataFrame:
    """Some tags count only on dates their filing also tags the balance-sheet total."""
    dates = facts.where((F.col("tag") == BALANCE_TOTAL) & (F.col("unit") == "USD")).select(*DATED).distinct()
    hit = F.col("tag").isin(*BALANCE_SHEET_ONLY)
    return facts.where(~hit).unionByName(facts.where(hit).join(dates, DATED, "left_semi"))


def debt_on_balance_sheet_dates(facts: DataFrame) -> DataFrame:
    """Long-term debt counts on its filing's balance-sheet dates, where the filing has any."""
    dates = facts.where(F.col("tag").isin(BALANCE_TOTAL, "Assets") & (F.col("unit") == "USD")).select(*DATED).distinct()
    hit = F.col("tag").isin(*reg.TAGS["long_term_debt"])
    debt = facts.where(hit)
    without = debt.join(dates.select(*FILING).distinct(), FILING, "left_anti")
    return facts.where(~hit).unionByName(without).unionByName(debt.join(dates, DATED, "left_semi"))


def _instants(facts: DataFrame, tags: tuple[str, ...]) -> DataFrame:
    """Dollar instants of *tags*, one value per (filing, date, tag)."""
    return (facts.where(F.col("tag").isin(*tags) & (F.col("unit") == "USD") & F.col("start").isNull())
            .groupBy(*DATED, "tag").agg(F.max("val").alias("val"), F.max("filed").alias("filed")))


def _wide(long: DataFrame, keys: list[str], tags: dict[str, str]) -> DataFrame:
    """Columns named by *tags* (tag -> name) of the rows of *long*."""
    return long.groupBy(*keys).agg(*[F.max(F.when(F.col("tag") == t, F.col("val"))).alias(n) for t, n in tags.items()])


def cash_totals_set_aside(facts: DataFrame) -> DataFrame:
    """Drops the restricted-cash total where equivalents plus some restricted parts of the same filing date make it up."""
    w = _wide(_instants(facts, (RESTRICTED_CASH, CASH_EQUIVALENTS)), DATED, {RESTRICTED_CASH: "t", CASH_EQUIVALENTS: "e"})
    w = w.where(F.col("t").isNotNull() & F.col("e").isNotNull())
    beside = (facts.where((F.col("unit") == "USD") & F.col("start").isNull() & (F.col("tag").startswith("Restricted") | F.col("tag").startswith("DepositsAssets")))
              .groupBy(*DATED, "tag").agg(F.max("val").alias("v")).groupBy(*DATED).agg(F.collect_list("v").alias("parts")))
    # Subset sums of one filing date's few restricted-cash lines.
    sums = F.aggregate("parts", F.array(F.lit(0.0)), lambda acc, v: F.array_distinct(F.concat(acc, F.transform(acc, lambda s: s + v))))
    j = w.join(beside, DATED).withColumn("__s", F.array_remove(sums, 0.0))
    aside = j.where(F.exists("__s", lambda s: agree(s, F.col("t") - F.col("e")))).select(*DATED)
    hit = F.col("tag") == RESTRICTED_CASH
    return facts.where(~hit).unionByName(facts.where(hit).join(aside, DATED, "left_anti"))


def cash_parts_set_aside(facts: DataFrame) -> DataFrame:
    """Drops a filing's Cash where its restricted-cash total agrees with a larger cash line this or an earlier filing
    shows on the date: Cash is then only a part."""
    tags = {RESTRICTED_CASH: "t", CASH: "c", CASH_EQUIVALENTS: "e", **{l: f"l{i}" for i, l in enumerate(CASH_LINES)}}
    i = _instants(facts, tuple(tags))
    w = _wide(i, DATED, tags).join(i.groupBy(*FILING).agg(F.max("filed").alias("filed")), FILING)
    c = F.col("c")
    lines = F.array_compact(F.array(*[F.col(f"l{k}") for k in range(len(CASH_LINES))], F.when(F.col("e") != 0, c + F.col("e"))))
    shown = (w.where(c.isNotNull()).select("ticker", "end", F.col("filed").alias("day"), "c", F.explode(lines).alias("line"))
             .where((F.col("line") > F.col("c")) & ~agree(F.col("line"), F.col("c"))))
    shown = shown.groupBy("ticker", "end", "line").agg(F.min("day").alias("day"))
    totals = w.where(F.col("t").isNotNull()).select("ticker", "accn", "end", "t", "filed")
    parts = (totals.join(shown, ["ticker", "end"]).where((F.col("day") <= F.col("filed")) & agree(F.col("line"), F.col("t")))
             .select(*FILING).distinct())
    hit = F.col("tag") == CASH
    return facts.where(~hit).unionByName(facts.where(hit).join(parts, FILING, "left_anti"))


def net_outflows_as_paid(facts: DataFrame) -> DataFrame:
    """Turns the net outflows of filings whose gross outflows are mostly negative."""
    gross = [t for f in reg.FIELDS if reg.SIGN[f] == "abs" for t in reg.TAGS[f]]
    net = [t for f in reg.FIELDS if reg.SIGN[f] == "net" for t in reg.TAGS[f]]
    votes = (facts.where(F.col("tag").isin(*gross) & (F.col("unit") == "USD") & F.col("start").isNotNull())
             .groupBy(*FILING).agg(F.sum(-F.signum("val")).alias("__vote")).where(F.col("__vote") > 0))
    hit = F.col("tag").isin(*net)
    turned = facts.where(hit).join(votes, FILING, "left").withColumn("val", F.when(F.col("__vote") > 0, -F.col("val")).otherwise(F.col("val"))).drop("__vote")
    return facts.where(~hit).unionByName(turned.select(*facts.columns))


def debt_parts_set_aside(facts: DataFrame) -> DataFrame:
    """Drops a debt figure under half of one of the same kind ranked after it, and its repeats in later filings."""
    order = {t: i for i, t in enumerate(reg.TAGS["long_term_debt"])}
    out = []
    for kind in DEBT_KINDS:
        tags = tuple(t for t in order if t in kind)
        i = _instants(facts, tags)
        w = _wide(i, DATED, {t: f"v{order[t]}" for t in tags}).join(i.groupBy(*FILING).agg(F.max("filed").alias("filed")), FILING)
        arr = []
        for k, t in enumerate(tags):
            v = F.col(f"v{order[t]}")
            later = [F.coalesce(F.col(f"v{order[x]}") * PART > v, F.lit(False)) for x in tags[k + 1:]]
            if later:
                arr.append(F.when(v.isNotNull() & reduce(lambda a, b: a | b, later), F.struct(F.lit(t).alias("tag"), v.alias("val"))))
        p = w.select("ticker", "end", "filed", F.explode(F.array_compact(F.array(*arr))).alias("p"))
        first = p.groupBy("ticker", "end", F.col("p.tag").alias("tag"), F.col("p.val").alias("val")).agg(F.min("filed").alias("__first"))
        out.append(i.join(first, ["ticker", "end", "tag", "val"]).where(F.col("filed") >= F.col("__first")).select(*DATED, "tag"))
    aside = reduce(lambda a, b: a.unionByName(b), out).distinct()
    return facts.join(aside, [*DATED, "tag"], "left_anti")


def _durations(facts: DataFrame, figures: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """Filing periods with *figures* (out -> field, tags) side by side: each the largest of its field under the first of
    its tags that the filing has for the period, and ``has_<out>``, whether there is one (it may be NULL).

    Facts meet by filing period as they are, narrow, and are read there in one pass.
    """
    c, of = F.col, sorted({(t, reg.UNIT[field]) for field, tags in figures.values() for t in tags})
    fits = reduce(lambda a, b: a | b, [(c("tag") == t) & (c("unit") == u) for t, u in of])
    f = facts.where(fits & c("start").isNotNull()).dropna(subset=DATED).select(*PERIOD, "tag", "unit", "val").repartition(*PERIOD)
    on = {x: (c("tag") == x[0]) & (c("unit") == x[1]) for x in of}
    low, empty = {x: f"__low{i}" for i, x in enumerate(of)}, {x: f"__empty{i}" for i, x in enumerate(of)}
    seen = f.groupBy(*PERIOD).agg(*[F.min(F.when(on[x], -c("val"))).alias(low[x]) for x in of], *[F.max(F.when(on[x] & c("val").isNull(), True)).alias(empty[x]) for x in of])

    def read(field: str, tags: list[str]) -> Column:
        keys = [(t, reg.UNIT[field]) for t in tags]
        return reduce(lambda rest, x: F.when(c(empty[x]), None).when(c(low[x]).isNotNull(), -c(low[x])).otherwise(rest), reversed(keys), F.lit(None).cast("double"))

    has = lambda field, tags: F.coalesce(*[c(n[t, reg.UNIT[field]]).isNotNull() | F.lit(None) for t in tags for n in (low, empty)], F.lit(False))
    return seen.select(*PERIOD, *[read(*x).alias(n) for n, x in figures.items()], *[has(*x).alias(f"has_{n}") for n, x in figures.items()])


def bank_revenue_parts(facts: DataFrame) -> DataFrame:
    """(period, tag): revenue figures under 0.8 of net interest plus noninterest income of their filing's period."""
    j = _durations(facts, {n: (f, reg.TAGS[f]) for n, f in (("a", "net_interest_income"), ("b", "noninterest_income"))}).where("a IS NOT NULL AND b IS NOT NULL")
    rev = (facts.where(F.col("tag").isin(*reg.TAGS["revenue"]) & (F.col("unit") == "USD") & F.col("start").isNotNull())
           .groupBy(*PERIOD, "tag").agg(F.max("val").alias("val")))
    return rev.join(j, PERIOD).where(F.col("val") < BANK_REVENUE_SHARE * (F.col("a") + F.col("b"))).select(*PERIOD, "tag")


def _eps_gap(figure: Column, eps: Column, count: Column) -> Column:
    implied = figure / F.nullif(eps, F.lit(0.0))
    gaps = [F.abs(count * s / F.nullif(implied, F.lit(0.0)) - 1.0) for s in SCALES]
    return F.when((count > 0) & (implied > 0), F.least(*gaps)).otherwise(F.lit(float("inf")))


def _with_pair(facts: DataFrame, figures: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """Filing periods with a to-common figure (``v``) and *figures*, and the EPS and count they divide by: the basic pair, else the diluted."""
    pairs = {f"__{x}{k}": (f, reg.TAGS[f]) for k, pair in enumerate(EPS_PAIRS) for x, f in zip("ec", pair)}
    # A table, so that the checks are worked out on the figures and not on what they are read from.
    j = as_table(_durations(facts, {"v": ("net_income", [TO_COMMON]), **figures, **pairs}).where("has_v"), "eps-figures")
    e0, e1 = (F.when(F.col(f"has___c{k}"), F.col(f"__e{k}")) for k in range(2))
    return j.withColumns({"__eps": F.coalesce(e0, e1), "__n": F.when(e0.isNotNull(), F.col("__c0")).otherwise(F.col("__c1"))})


def to_common_contradicted(facts: DataFrame) -> DataFrame:
    """Periods whose to-common figure its filing's EPS x count contradicts."""
    j = _with_pair(facts, {})
    return j.where((F.abs("__eps") >= MIN_CHECKING_EPS) & (_eps_gap(F.col("v"), F.col("__eps"), F.col("__n")) > SCALE_TOLERANCE)).select(*PERIOD)


def to_common_set_aside(facts: DataFrame) -> DataFrame:
    """Periods whose to-common figure is off EPS x count while a later-ranked net income tag matches it."""
    tags = reg.TAGS["net_income"]
    later = {f"o{k}": ("net_income", [t]) for k, t in enumerate(tags[tags.index(TO_COMMON) + 1:])}
    j = _with_pair(facts, later).where(F.col("__eps").isNotNull())
    j = j.where(_eps_gap(F.col("v"), F.col("__eps"), F.col("__n")) > SCALE_TOLERANCE)
    hit = F.lit(False)
    for k in range(len(later)):
        hit = hit | F.coalesce(_eps_gap(F.col(f"o{k}"), F.col("__eps"), F.col("__n")) <= SCALE_TOLERANCE, F.lit(False))
    return j.where(hit).select(*PERIOD)


def _latest_by_year(facts: DataFrame, tags: list[str]) -> DataFrame:
    """(ticker, fiscal_year, tag, val): each annual report figure of a full year, latest filed."""
    from finstrata.operators.periods import fiscal_year_of
    f = facts.where(F.col("tag").isin(*tags) & F.col("form").isin(*reg.ANNUAL_FORMS) & F.datediff("end", "start").between(350, 380))
    return f.groupBy("ticker", fiscal_year_of("end").alias("fiscal_year"), "tag").agg(F.max_by("val", F.struct("filed", "accn")).alias("val"))


def revenue_set_aside(facts: DataFrame) -> DataFrame:
    """(ticker, fiscal_year, tag): revenue figures that are not the year's revenue.

    A figure gives way to one at least a quarter away that the income statement adds up to while it does not; where
    the statement adds up to none, one of 0 or less to a positive one, and one below the cost of revenue to one that
    is not. A year has a handful of revenue tags, compared inside one array.
    """
    revenue, lines = [t for t in reg.TAGS["revenue"] if t != WITH_TAXES], ("cost_of_revenue", "gross_profit", "operating_income", "operating_expenses")
    key = ["ticker", "fiscal_year"]
    of = lambda tags: F.array_position(F.array(*map(F.lit, tags)), F.col("tag"))
    line = lambda n: F.min_by("val", F.when(F.col("tag").isin(*reg.TAGS[n]) & F.col("ticker").isNotNull(), of(reg.TAGS[n]))).alias(n)
    years = _latest_by_year(facts, list(dict.fromkeys([*revenue, *(t for n in lines for t in reg.TAGS[n])])))
    figs = years.groupBy(*key).agg(F.collect_list(F.when(F.col("tag").isin(*revenue), F.struct("tag", "val"))).alias("f"), *map(line, lines)).where(F.size("f") > 0)
    totals = F.array_compact(F.array(F.col("operating_income") + F.col("operating_expenses"), F.col("cost_of_revenue") + F.col("gross_profit")))
    figs = figs.withColumn("__t", totals)
    figs = figs.withColumn("f", F.transform("f", lambda s: F.struct(s["tag"].alias("tag"), s["val"].alias("val"),
                           F.exists("__t", lambda t: agree(s["val"], t)).alias("adds"))))
    figs = figs.withColumn("__any", F.exists("f", lambda s: s["adds"]))
    floor = F.col("cost_of_revenue")

    def gives_way(a: Column, b: Column) -> Column:
        v, o = a["val"], b["val"]
        apart = ((v <= 0) & (o > 0)) | ((v > 0) & (v * REVENUE_GAP <= o)) | ((o > 0) & (o * REVENUE_GAP <= v))
        unsupported = ((v <= 0) & (o > 0)) | F.coalesce((v < floor) & (floor <= o), F.lit(False))
        return apart & F.when(F.col("__any"), b["adds"] & ~a["adds"]).otherwise(unsupported)

    bad = F.filter("f", lambda a: F.exists("f", lambda b: gives_way(a, b)))
    return figs.select(*key, F.explode(bad).alias("b")).select(*key, F.col("b.tag").alias("tag"))


def merge_predecessor(facts: DataFrame, predecessor_facts: DataFrame, mapping: DataFrame) -> DataFrame:
    """The successor's facts and its predecessor's filed before the successor's first report.

    *mapping*: ticker, predecessor (the ticker its facts carry).
    """
    report = reduce(lambda a, b: a | b, [F.col("form").startswith(f) for f in REPORT_FORMS])
    first = facts.where(report).groupBy("ticker").agg(F.min("filed").alias("__first"))
    old = predecessor_facts.withColumnRenamed("ticker", "predecessor").join(mapping, "predecessor").join(first, "ticker", "left")
    old = old.where(F.col("__first").isNull() | (F.col("filed") < F.col("__first")))
    return facts.unionByName(old.select(*facts.columns))


def report_gap(listed: DataFrame, facts: DataFrame, limit: int) -> DataFrame:
    """Listed reports no fact carries, newest first up to the first that facts carry, *limit* per company at most
    (the newest *limit* reports are the ones looked at)."""
    w = Window.partitionBy("ticker").orderBy(F.desc("filed"), F.desc("accn"))
    r = listed.where(F.col("form").isin(*REPORT_FORMS)).withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= limit)
    have = facts.select(*FILING).distinct().withColumn("__have", F.lit(1))
    j = r.join(have, FILING, "left").withColumn("__seen", F.max(F.coalesce("__have", F.lit(0))).over(w))
    return j.where(F.col("__seen") == 0).select(*listed.columns)


def merge_report_facts(facts: DataFrame, read: DataFrame) -> DataFrame:
    """Adds facts read from reports themselves; a filing the facts already carry wins."""
    return facts.unionByName(read.join(facts.select(*FILING).distinct(), FILING, "left_anti").select(*facts.columns))


def unmapped_facts(facts: DataFrame, known_tags: DataFrame, min_value: float = 1_000_000.0, since_year: int = 0,
                   forms: tuple[str, ...] = ("10-K", "10-K/A", "10-Q", "10-Q/A", "20-F", "40-F")) -> DataFrame:
    """The latest material dollar fact of each tag outside the registry."""
    f = facts.where((F.col("unit") == "USD") & (F.abs("val") >= min_value) & (F.year("end") >= since_year) & F.col("form").isin(*forms))
    f = f.join(F.broadcast(known_tags.select("tag").distinct()), "tag", "left_anti")  # the registry: a few hundred tags
    return f.groupBy("ticker", "tag").agg(F.max("end").alias("period_end"), F.max_by("val", F.struct("end", "filed", "accn", "val")).alias("value"))


def explain_record(facts: DataFrame, annual: DataFrame, stale_before: Column) -> DataFrame:
    """(ticker, reason): why a company's annual record is empty or stale."""
    g = facts.groupBy("ticker").agg(F.max((F.col("unit") == "USD").cast("int")).alias("usd"),
                                    F.max(F.col("form").isin(*reg.ANNUAL_FORMS).cast("int")).alias("annual"),
                                    F.max(F.col("tag").isin(*[t for ts in reg.TAGS.values() for t in ts]).cast("int")).alias("known"))
    a = annual.groupBy("ticker").agg(F.max("period_end").alias("last"))
    j = g.join(reporting_currency(facts), "ticker", "left").join(a, "ticker", "left")
    reason = (F.when(F.col("last").isNull(), F.when(F.col("annual") == 0, F.lit("no annual report among its facts"))
                     .when(F.col("known") == 0, F.lit("no fact under a mapped tag (IFRS only)"))
                     .when(F.col("currency") != "USD", F.concat(F.lit("reports in "), "currency"))
                     .otherwise(F.lit("no full-year figure in an annual report")))
              .when(F.col("last") < stale_before, F.concat(F.lit("its latest year ended "), F.col("last").cast("string"))))
    return j.select("ticker", reason.alias("reason")).where(F.col("reason").isNotNull())


def known_by(facts: DataFrame, day: Column) -> DataFrame:
    """Facts filed by *day*; one without a filing day is never known."""
    return facts.where(F.col("filed") <= day)


def filing_dates(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("filed").isNotNull()).select("ticker", "filed").distinct()


def undated(facts: DataFrame) -> DataFrame:
    return facts.groupBy("ticker").agg(F.sum(F.col("filed").isNull().cast("int")).alias("undated"))


# The noncurrent lines outside the registry, and how much of a total the parts must make up.
DEBT_LINES = ("LongTermNotesAndLoans", "SeniorLongTermNotes", "OtherLongTermDebtNoncurrent", "LongTermLoansPayable")
NEXT_MATURITIES = "LongTermDebtMaturitiesRepaymentsOfPrincipalInNextTwelveMonths"
NONCURRENT = ("LongTermDebtAndCapitalLeaseObligations", "LongTermNotesPayable", "UnsecuredLongTermDebt", "ConvertibleLongTermNotesPayable")
MATURITIES = ("LongTermDebtCurrent", "LongTermDebtAndCapitalLeaseObligationsCurrent")
MADE_UP = 0.05


def debt_totals_set_aside(facts: DataFrame) -> DataFrame:
    """Drops the LongTermDebt total where the filing's noncurrent figure and current debt already hold it (FCT-9).

    A noncurrent line outside the registry that makes up the total with a current figure stands in for it.
    """
    tags = {"LongTermDebt": "t", "LongTermDebtNoncurrent": "own", "DebtCurrent": "dc", "ShortTermBorrowings": "sb", NEXT_MATURITIES: "nx",
            **{x: f"m{i}" for i, x in enumerate(MATURITIES)}, **{x: f"n{i}" for i, x in enumerate(NONCURRENT)}, **{x: f"l{i}" for i, x in enumerate(DEBT_LINES)}}
    w = _wide(_instants(facts, tuple(tags)), DATED, tags).where(F.col("t").isNotNull())
    c = F.col
    first_n = F.coalesce(*[c(f"n{i}") for i in range(len(NONCURRENT))])
    makes_up = lambda v: F.greatest(*[F.coalesce((x > 0) & agree(v + x, c("t")), F.lit(False)).cast("int") for x in (c("dc"), c("m0"), c("m1"), c("nx"))]) == 1
    fits = [F.when(c(f"l{i}").isNotNull() & makes_up(c(f"l{i}")), F.struct(F.lit(x).alias("tag"), c(f"l{i}").alias("v"))) for i, x in enumerate(DEBT_LINES)]
    line = F.when(first_n.isNull() & c("own").isNull(), F.coalesce(*fits))
    w = w.withColumn("line", line).withColumn("n", F.coalesce(first_n, F.col("line.v")))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    either = F.greatest(c("m0"), c("m1"))
    holds = (F.when(c("dc").isNotNull(), c("dc") > 0)
             .when((c("sb") > 0) & (c("sb") == c("m0")), True).when(c("sb").isNull() & (c("m0") > 0), True)
             .otherwise((either > 0) & (c("n") + zero(c("sb")) + either >= (1 - MADE_UP) * c("t"))))
    aside = w.where(c("n").isNotNull() & ((c("t") < c("n")) | F.coalesce(holds, F.lit(False)))).select(*DATED, "line")
    hit = F.col("tag") == "LongTermDebt"
    kept = facts.where(~hit).unionByName(facts.where(hit).join(aside.select(*DATED), DATED, "left_anti"))
    named = aside.where(F.col("line").isNotNull()).select(*DATED, F.col("line.tag").alias("__tag"))
    stand_in = (facts.where(F.col("tag").isin(*DEBT_LINES)).join(named, DATED).where(F.col("tag") == F.col("__tag"))
                .withColumn("tag", F.lit("LongTermDebtNoncurrent")).select(*facts.columns))
    return kept.unionByName(stand_in)
