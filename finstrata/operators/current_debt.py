"""Current debt where filings tag borrowings and maturities apart (FCT-10), and short-term debt before a refinancing or with its paper inside (FCT-11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finstrata.operators.facts import AGREE, BALANCE_TOTAL, DATED, MATURITIES, NONCURRENT, agree
from finstrata.session import as_table

# Tags and tolerances of the rules.
DEBT, BORROWINGS, PAPER, REFINANCED, TOTAL, APART = "DebtCurrent", "ShortTermBorrowings", "CommercialPaper", "ShortTermDebtRefinancedAmount", "LongTermDebt", "LongTermDebtNoncurrent"
PARTS = (PAPER, "OtherShortTermBorrowings", "ShortTermBankLoansAndNotesPayable", "ShortTermNonBankLoansAndNotesPayable", "LinesOfCreditCurrent", "BankOverdrafts")
OWN_TOTAL, OWN_DEBT_AND_LEASES = "DebtLongtermAndShorttermCombinedAmount", "DebtAndCapitalLeaseObligations"
TRADE, TAXES = ("AccountsPayableCurrent", "AccountsPayableTradeCurrent"), ("TaxesPayableCurrent", "AccruedIncomeTaxesCurrent")
ACCRUED_PAY, PAYABLES_AND_ACCRUALS, CURRENT = "EmployeeRelatedLiabilitiesCurrent", "AccountsPayableAndAccruedLiabilitiesCurrent", "LiabilitiesCurrent"
ANNUAL_FORMS, QUARTERLY_FORMS = ("10-K", "10-K/A", "20-F", "20-F/A", "40-F", "40-F/A"), ("10-Q", "10-Q/A", "10-K", "10-K/A")
HOLD_MARGIN, MATURITIES_ROUNDING, PAPER_ROUNDING = 0.01, 0.02, 0.02
VIEWS = {"annual": ANNUAL_FORMS, "quarterly": QUARTERLY_FORMS, "vintage": None}

_NAMES = {DEBT: "dc", BORROWINGS: "sb", TOTAL: "t", APART: "apart", OWN_TOTAL: "own", OWN_DEBT_AND_LEASES: "own2", ACCRUED_PAY: "emp", PAYABLES_AND_ACCRUALS: "pay", CURRENT: "lc", BALANCE_TOTAL: "bs",
          **{x: f"m{i}" for i, x in enumerate(MATURITIES)}, **{x: f"p{i}" for i, x in enumerate(PARTS)}, **{x: f"n{i}" for i, x in enumerate(NONCURRENT)},
          **{x: f"trade{i}" for i, x in enumerate(TRADE)}, **{x: f"tax{i}" for i, x in enumerate(TAXES)}}


def _zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0))


def _by_date(facts: DataFrame, names: dict[str, str]) -> DataFrame:
    """Each filing date's figures side by side, with the filing's form and day.

    Facts meet by filing date as they are, narrow, and are put side by side there. A form is a text, which a hashed aggregate
    cannot keep as a maximum, so it is a key first; a date's forms (mostly one) then give way to the last of them.
    """
    f = facts.where(F.col("tag").isin(*names) & (F.col("unit") == "USD") & F.col("start").isNull() & F.col("val").isNotNull())
    f = f.dropna(subset=DATED).select(*DATED, F.array_position(F.array(*map(F.lit, names)), F.col("tag")).cast("int").alias("__i"), "val", "form", "filed")
    figures = lambda c: [F.max(c(i, n)).alias(n) for i, n in enumerate(names.values(), 1)]
    f = f.repartition(*DATED).groupBy(*DATED, "form").agg(*figures(lambda i, n: F.when(F.col("__i") == i, F.col("val"))), F.max("filed").alias("filed"))
    return f.groupBy(*DATED).agg(*figures(lambda i, n: F.col(n)), F.max("form").alias("form"), F.max("filed").alias("filed"))


def _maturities() -> Column:
    return F.greatest(_zero("m0"), _zero("m1"), F.lit(0.0))


def _read(facts: DataFrame) -> DataFrame:
    """Filing dates with ``kept`` (a long-term total that holds the maturities is read there)."""
    w = _by_date(facts, _NAMES)
    line = F.coalesce(*[F.col(f"n{i}") for i in range(len(NONCURRENT))])
    kept = F.col("t").isNotNull() & F.col("form").isin(*ANNUAL_FORMS, *QUARTERLY_FORMS) & F.col("apart").isNull() & ~F.coalesce(agree(F.col("t"), line), F.lit(False))
    return w.withColumns({"nc": F.coalesce("apart", line), "kept": kept})


def _total_dates(w: DataFrame) -> DataFrame:
    """(ticker, end) where an annual report's total holds the maturities and none shows the rest apart."""
    says = w.where(F.col("form").isin(*ANNUAL_FORMS) & (F.col("kept") | F.col("apart").isNotNull()))
    return says.groupBy("ticker", "end").agg(F.max("kept").alias("total"), F.max(F.col("apart").isNotNull()).alias("parted")).where(F.col("total") & ~F.col("parted")).select("ticker", "end")


def _borrowings_hold() -> Column:
    """Whether the borrowings hold the maturities, where the filing tells: by its own total debt, by what its current
    liabilities leave, by the borrowings' own parts, or by the two figures being nearly one; else NULL."""
    b, m, nc = F.col("sb"), F.col("hi"), F.col("nc")

    def told(total: Column, only_apart: bool) -> Column:
        alone, both = F.abs(total - nc - b), F.abs(total - nc - b - m)
        near = (F.least(alone, both) <= AGREE * F.abs(total)) & ((both < alone) | F.lit(not only_apart))
        return F.when(total.isNotNull() & nc.isNotNull() & near, alone < both)

    trade, taxes = F.greatest(_zero("trade0"), _zero("trade1"), F.lit(0.0)), F.greatest(_zero("tax0"), _zero("tax1"), F.lit(0.0))
    pay, emp = F.greatest(_zero("pay"), F.lit(0.0)), F.greatest(_zero("emp"), F.lit(0.0))
    lines = F.greatest(F.when(trade > 0, trade + emp + taxes).otherwise(pay + taxes), pay)
    lines = F.when(lines <= F.col("lc"), lines).otherwise(0.0)
    full = (F.col("lc") > 0) & (b + m + lines > F.col("lc") * (1 + AGREE))
    parts = F.col("parts")
    made_of_parts = (parts > 0) & agree(b, parts) & ((b != m) | F.col("elsewhere"))
    return F.coalesce(told(F.col("own"), False), told(F.col("own2"), True), F.when(full, True), F.when(made_of_parts, False),
                      F.when((parts > 0) & agree(b, m + parts), True), F.when((b - m >= 0) & (b - m <= HOLD_MARGIN * b), True))


def current_debt_combinations(facts: DataFrame, view: str = "annual") -> tuple[DataFrame, DataFrame]:
    """(ticker, accn, end, form, filed, val) of the DebtCurrent that borrowings and maturities make together, and the
    (ticker, accn, end) whose second maturities figure a long-term total holds already.

    Not where the borrowings hold the maturities. A quarter that does not tell takes the word of the latest year end at
    or before it. For the annual and quarterly records the latest filing of their forms that tells a date decides it.
    """
    w = _read(facts)
    parts = sum((F.greatest(_zero(f"p{i}"), F.lit(0.0)) for i in range(len(PARTS))), F.lit(0.0))
    w = w.withColumn("parts", parts)
    own_line = F.coalesce(F.col("sb").isNotNull() & (F.col("parts") > 0) & agree(F.col("sb"), F.col("parts")) & (_maturities() > 0) & (_maturities() != F.col("sb")), F.lit(False)).cast("int")
    # Read many times over below, a few columns each.
    w = as_table(w.withColumn("own_line", own_line), "current-debt")
    own_lines = w.where("own_line = 1").groupBy("ticker", "accn").agg(F.sum("own_line").alias("own_lines"))
    m = [F.when(F.col(c) > 0, F.col(c)) for c in ("m0", "m1")]
    held_by_total = w.where(F.col("m1").isNotNull() & F.col("kept")).select(*DATED)
    d = w.where((F.col("sb") >= 0) & F.col("dc").isNull() & F.coalesce(*m).isNotNull() & ~F.col("kept"))
    if view != "vintage":
        dates = _total_dates(w)
        held_by_total = held_by_total.unionByName(w.where(F.col("m1").isNotNull() & ~F.coalesce("kept", F.lit(False))).select(*DATED).join(dates, ["ticker", "end"], "left_semi").select(*DATED))
        d = d.join(dates, ["ticker", "end"], "left_anti")
    d = d.withColumns({"hi": F.greatest(*m), "lo": F.least(*m)})
    d = d.withColumn("val", F.when((F.col("lo") != F.col("hi")) & agree(F.col("hi"), F.col("sb") + F.col("lo")), F.col("hi")).otherwise(F.col("sb") + F.col("hi")))
    d = d.join(own_lines, ["ticker", "accn"], "left").withColumn("elsewhere", F.coalesce("own_lines", F.lit(0)) > F.col("own_line"))
    d = as_table(d.select(*DATED, "form", "filed", "sb", "hi", "val", _borrowings_hold().alias("held")), "current-debt-asked")
    annual = F.col("form").isin(*ANNUAL_FORMS)

    ends = w.where(annual & F.col("bs").isNotNull()).select("ticker", F.col("end").alias("y")).distinct()
    ask = d.where(F.col("held").isNull() & ~annual & (F.col("sb") >= F.col("hi") * (1 - MATURITIES_ROUNDING))).select(*DATED)
    last = ask.join(ends, "ticker").where(F.col("y") <= F.col("end")).groupBy(*DATED).agg(F.max("y").alias("y"))
    held_ends = d.where(annual & F.col("held")).select("ticker", F.col("end").alias("y")).distinct().withColumn("by_year", F.lit(True))
    line = w.where(F.col("sb").isNotNull()).select("ticker", "accn", F.col("end").alias("y"), F.col("sb").alias("line"))
    debts = w.where(annual & F.col("dc").isNotNull()).groupBy("ticker", F.col("end").alias("y")).agg(F.collect_set("dc").alias("debts"))
    said = last.join(held_ends, ["ticker", "y"], "left").join(line, ["ticker", "accn", "y"], "left").join(debts, ["ticker", "y"], "left")
    said = said.where(F.coalesce("by_year", F.exists("debts", lambda x: agree(x, F.col("line"))), F.lit(False))).select(*DATED, F.lit(True).alias("said"))
    d = d.join(said, DATED, "left").withColumn("held", F.coalesce("held", "said", F.lit(False)))

    out = d.where(~F.col("held"))
    if view != "vintage":
        tells = w.where(F.col("dc").isNotNull()).select(*DATED, "form", "filed").unionByName(d.select(*DATED, "form", "filed")).where(F.col("form").isin(*VIEWS[view]))
        latest = tells.groupBy("ticker", "end").agg(F.max_by("accn", F.struct("filed", "accn")).alias("accn"))
        out = out.join(latest, DATED, "left_semi")
    return out.select(*DATED, "form", "filed", "val"), held_by_total


def current_debt_combined(facts: DataFrame, view: str = "annual", judged: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """*facts* with those combinations as DebtCurrent, less the maturities a long-term total holds (FCT-10).

    *judged*: the combinations, where they were judged on other facts than these.
    """
    combined, held = judged or current_debt_combinations(facts, view)
    hit = F.coalesce(F.col("tag") == MATURITIES[1], F.lit(False))
    kept = facts.where(hit).join(held, DATED, "left_anti").select(*facts.columns)
    return facts.where(~hit).unionByName(kept).unionByName(combined.withColumns({"tag": F.lit(DEBT), "unit": F.lit("USD"), "start": F.lit(None).cast("date")}).select(*facts.columns))


def current_debt_set_aside(facts: DataFrame, view: str = "annual", combined: DataFrame | None = None) -> DataFrame:
    """*facts* less a DebtCurrent before a refinancing, and with 0 for paper inside the short-term figure read beside it (FCT-11).

    A DebtCurrent less the refinanced amount that is the filing's borrowings goes. Paper counts as inside if the
    short-term figure on its date is not below it: the latest DebtCurrent (combinations among them), else the latest
    borrowings, of the record's forms; a DebtCurrent below its own filing's maturities holds none. Each annual report's
    vintage reads the latest short-term figure filed by then, and one that shows such a figure but no paper states the
    latest paper filed before, or 0 where its own figure holds it.
    """
    names = {DEBT: "dc", BORROWINGS: "sb", PAPER: "cp", **{x: f"m{i}" for i, x in enumerate(MATURITIES)}}
    w = as_table(_by_date(facts, names), "short-term-debt")
    moved = facts.where((F.col("tag") == REFINANCED) & (F.col("unit") == "USD")).groupBy(*DATED).agg(F.max("val").alias("moved"))
    before = w.join(moved, DATED).where((F.col("moved") > 0) & agree(F.col("dc") - F.col("moved"), F.col("sb"))).select(*DATED)
    w = w.withColumn("holder", F.when(F.col("dc").isNotNull(), F.when(F.col("dc") >= _maturities() * (1 - AGREE), F.col("dc"))).otherwise(F.col("sb")))
    inside = lambda holder, paper: F.coalesce((paper > 0) & (F.coalesce(holder, F.lit(0.0)) >= paper * (1 - PAPER_ROUNDING)), F.lit(False))
    stated = None
    if view != "vintage":
        r = w.where(F.col("form").isin(*VIEWS[view]))
        r = r.join(combined.select(*DATED, F.lit(True).alias("made")), DATED, "left") if combined is not None else r.withColumn("made", F.lit(None).cast("boolean"))
        rank = F.when(F.col("dc").isNotNull() | F.coalesce("made", F.lit(False)), 2).when(F.col("sb").isNotNull(), 1)
        source = r.withColumn("rank", rank).where(F.col("rank").isNotNull()).groupBy("ticker", "end").agg(F.max_by(F.struct("holder"), F.struct("rank", "filed", "accn")).alias("source"))
        held = w.where(F.col("cp").isNotNull()).join(source, ["ticker", "end"]).where(inside(F.col("source.holder"), F.col("cp"))).select(*DATED)
    else:
        shows = F.coalesce("dc", "sb", "m0", "m1").isNotNull()
        date = Window.partitionBy("ticker", "end").orderBy("filed", "accn")
        r = w.where(F.col("form").isin(*ANNUAL_FORMS)).withColumn("source", F.last(F.when(shows, F.struct("holder")), ignorenulls=True).over(date))
        r = r.withColumn("paper", F.last("cp", ignorenulls=True).over(date.rowsBetween(Window.unboundedPreceding, -1)))
        held = r.where(F.col("cp").isNotNull() & F.col("source").isNotNull() & inside(F.col("source.holder"), F.col("cp"))).select(*DATED)
        stated = r.where(F.col("cp").isNull() & shows & (F.col("paper") > 0)).select(*DATED, "form", "filed", F.when(inside(F.col("holder"), F.col("paper")), 0.0).otherwise(F.col("paper")).alias("val"))
    # Only the two tags that may change meet their dates; all other facts pass by.
    tag = F.coalesce("tag", F.lit(""))
    debt = facts.where(tag == DEBT).join(before, DATED, "left_anti").select(*facts.columns)
    paper = facts.where(tag == PAPER).join(held.select(*DATED, F.lit(True).alias("__in")), DATED, "left")
    paper = paper.withColumn("val", F.when(F.col("__in"), 0.0).otherwise(F.col("val"))).select(*facts.columns)
    out = facts.where(~tag.isin(DEBT, PAPER)).unionByName(debt).unionByName(paper)
    if stated is not None:
        out = out.unionByName(stated.withColumns({"tag": F.lit(PAPER), "unit": F.lit("USD"), "start": F.lit(None).cast("date")}).select(*facts.columns))
    return out
