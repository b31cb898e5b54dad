"""Quarter figures put on their year's split basis and scale (RES-15, RES-16), and debt lines quarters name otherwise (RES-17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finstrata.functions.exprs import array_median
from finstrata.operators.facts import MATURITIES, NONCURRENT
from finstrata.operators.periods import YEAR_DAYS
from finstrata.operators.split_series import SCALE_TOLERANCE, SCALES

#: Balance-sheet concepts of the public taxonomy that are a line of long-term borrowings: without what is due within a
#: year, and as a whole.
NONCURRENT_LINES = (
    "LongTermDebtNoncurrent LongTermDebtAndCapitalLeaseObligations LongTermNotesPayable LongTermNotesAndLoans LongTermLoansPayable LongTermLoansFromBank LongTermLineOfCredit "
    "UnsecuredLongTermDebt SecuredLongTermDebt SeniorLongTermNotes SubordinatedLongTermDebt ConvertibleLongTermNotesPayable ConvertibleSubordinatedDebtNoncurrent ConvertibleDebtNoncurrent "
    "OtherLongTermDebtNoncurrent OtherLongTermNotesPayable OtherLoansPayableLongTerm ConstructionLoanNoncurrent MediumtermNotesNoncurrent JuniorSubordinatedDebentureOwedToUnconsolidatedSubsidiaryTrustNoncurrent "
    "NotesPayableRelatedPartiesNoncurrent FinanceLeaseLiabilityNoncurrent CapitalLeaseObligationsNoncurrent").split()
WHOLE_LINES = (
    "LongTermDebt LongTermDebtAndCapitalLeaseObligationsIncludingCurrentMaturities NotesPayable NotesAndLoansPayable NotesPayableToBank NotesPayableRelatedParties OtherNotesPayable SeniorNotes "
    "ConvertibleNotesPayable ConvertibleDebt MediumtermNotes SecuredDebt UnsecuredDebt SubordinatedDebt JuniorSubordinatedNotes LoansPayable LoansPayableToBank OtherLoansPayable LineOfCredit "
    "BankLoans OtherBorrowings OtherLongTermDebt LoansPayableLongTerm ConstructionLoan").split()
ANNUAL_FORMS, QUARTER_FORMS = ("10-K", "10-K/A", "20-F", "20-F/A", "40-F", "40-F/A"), ("10-Q", "10-Q/A")


def _with_restatements(rows: DataFrame, restatements: DataFrame) -> DataFrame:
    """Rows with their company's splits (few) as ``__s``."""
    s = restatements.groupBy("ticker").agg(F.collect_list(F.struct("through", F.col("ratio").cast("double").alias("ratio"))).alias("__s"))
    return rows.join(s, "ticker", "left")


def _level(filed: Column) -> Column:
    """The split basis of a filing's figures: the product of the splits it came after."""
    after = F.filter("__s", lambda x: x["through"] <= filed)
    return F.coalesce(F.aggregate(after, F.lit(1.0), lambda p, x: p * x["ratio"]), F.lit(1.0))


def rungs_on_year_basis(rungs: DataFrame, restatements: DataFrame) -> DataFrame:
    """Rungs (ticker, field, start, end, filed, val, is_count) on the basis of their year's annual figure; adds ``level``.

    A year is the rungs of one start, two or more; its basis is that of the latest filing of its full-year figure, else
    of its latest rung. A quarter that two years reach takes the later one's; one that none reaches keeps its own.
    """
    year = Window.partitionBy("ticker", "field", "start")
    whole = F.max(F.when(F.datediff("end", "start") >= YEAR_DAYS[0], F.col("filed"))).over(year)
    anchor = F.when(F.count("*").over(year) >= 2, F.coalesce(whole, F.max("filed").over(year)))
    r = rungs.withColumn("__a", anchor).withColumn("__a", F.coalesce(F.max("__a").over(Window.partitionBy("ticker", "field", "end")), "filed"))
    r = _with_restatements(r, restatements).withColumns({"level": _level(F.col("__a")), "__own": _level(F.col("filed"))})
    moved = F.col("level") / F.col("__own")
    return r.withColumn("val", F.when(F.col("is_count"), F.col("val") * moved).otherwise(F.col("val") / moved)).drop("__a", "__s", "__own")


def instants_on_year_basis(counts: DataFrame, restatements: DataFrame) -> DataFrame:
    """Quarter-end counts (ticker, field, fiscal_year, end, filed, val) on the basis of their year's latest filed one; adds ``level``."""
    latest = F.max("filed").over(Window.partitionBy("ticker", "field", "fiscal_year"))
    r = _with_restatements(counts.withColumn("__a", F.when(F.col("fiscal_year").isNotNull(), latest).otherwise(F.col("filed"))), restatements)
    r = r.withColumn("level", _level(F.col("__a")))
    return r.withColumn("val", F.col("val") * F.col("level") / _level(F.col("filed"))).drop("__a", "__s")


def _power(val: Column, implied: Column) -> Column:
    """The power of 1000 other than one that brings *val* within the tolerance of *implied*; NULL if none does."""
    off = lambda s: F.abs(val * s / implied - 1.0)
    best = F.array_min(F.array(*[F.struct(off(s).alias("gap"), F.lit(i).alias("i"), F.lit(s).alias("s")) for i, s in enumerate(SCALES)]))
    return F.when((val > 0) & (implied > 0) & (best["gap"] <= SCALE_TOLERANCE) & (best["s"] != 1.0), best["s"])


def rungs_on_one_scale(rungs: DataFrame, income: DataFrame, eps: DataFrame) -> DataFrame:
    """Weighted counts (ticker, start, end, val) on one scale within their year; *income* and *eps* have the same keys and ``val``.

    A rung whose income over EPS implies it times a power of 1000 takes that power if another rung of its year, as
    filed, is within a factor of two of the result, since EPS can be the figure that is off. A rung that nothing of its
    own checks takes the power that brings it to the median of its year's checked rungs. A year has a handful of rungs.
    """
    keys = ["ticker", "start", "end"]
    n = rungs.withColumn("__n", F.count("*").over(Window.partitionBy("ticker", "start")))
    ladder = F.min(F.when(F.col("__n") >= 2, F.col("start"))).over(Window.partitionBy("ticker", "end"))
    r = n.withColumn("__y", F.coalesce(ladder, "start")).drop("__n")
    r = r.join(income.select(*keys, F.col("val").alias("__i")), keys, "left").join(eps.select(*keys, F.col("val").alias("__e")), keys, "left")
    year = Window.partitionBy("ticker", "__y")
    mine = F.struct("start", "end")
    r = r.withColumn("__all", F.collect_list(F.when(F.col("val") > 0, F.struct(mine.alias("k"), F.col("val").alias("v")))).over(year))
    implied = F.abs(F.nullif(F.col("__i"), F.lit(0.0)) / F.nullif(F.col("__e"), F.lit(0.0)))
    power = _power(F.col("val"), implied)
    near = F.exists("__all", lambda o: (o["k"] != mine) & (F.col("val") * power / o["v"]).between(0.5, 2.0))
    r = r.withColumn("__p", F.when(F.coalesce(near, F.lit(False)), power))
    r = r.withColumn("val", F.col("val") * F.coalesce("__p", F.lit(1.0)))
    checked = (F.col("val") > 0) & F.coalesce(F.abs(F.col("val") / implied - 1.0) <= SCALE_TOLERANCE, F.lit(False))
    r = r.withColumn("__c", checked).withColumn("__m", F.collect_list(F.when(F.col("__c"), F.col("val"))).over(year))
    late = F.when(~F.coalesce("__c", F.lit(False)), _power(F.col("val"), array_median(F.col("__m"))))
    return r.withColumn("val", F.col("val") * F.coalesce(late, F.lit(1.0))).select(*rungs.columns)


def quarter_debt_lines(facts: DataFrame, annual: DataFrame, quarters: DataFrame) -> DataFrame:
    """(ticker, period_end, long_term_debt, tag) for quarters without long-term debt, from a line under another concept.

    A quarterly report's tag (one of NONCURRENT_LINES or WHOLE_LINES) is the line if at a year end it has the figure that an annual report filed there under the
    tag the annual record reads. Beside short-term debt it must hold no maturities: a noncurrent line, or equal to
    the annual record's noncurrent figure where an annual report shows maturities. Lines of a report that disagree are
    none; the latest report decides. *annual*: ticker, period_end, long_term_debt, tag; *quarters*: ticker, period_end,
    long_term_debt, short_term_debt.
    """
    f = facts.where((F.col("unit") == "USD") & F.col("start").isNull() & F.col("accn").isNotNull() & F.col("tag").isin(*NONCURRENT_LINES, *WHOLE_LINES, *MATURITIES))
    f = f.groupBy("ticker", "accn", "form", "filed", "end", "tag").agg(F.max("val").alias("val"))
    filed = f.where(F.col("form").isin(*ANNUAL_FORMS) & (F.col("val") > 0))
    record = annual.where(F.coalesce(F.col("long_term_debt"), F.lit(0.0)) != 0).select("ticker", F.col("period_end").alias("end"), "tag")
    figures = filed.join(record, ["ticker", "end", "tag"]).select("ticker", "end", "val").distinct()
    mature = filed.where(F.col("tag").isin(*MATURITIES)).select("ticker", "end").distinct()
    apart = record.where(F.col("tag").isin("LongTermDebtNoncurrent", *NONCURRENT)).join(mature, ["ticker", "end"]).select("ticker", "end", F.lit(True).alias("apart"))
    q = f.where(F.col("form").isin(*QUARTER_FORMS) & F.col("tag").isin(*NONCURRENT_LINES, *WHOLE_LINES))
    lines = q.join(figures, ["ticker", "end", "val"]).join(apart, ["ticker", "end"], "left").groupBy("ticker", "accn", "tag").agg(F.max(F.coalesce("apart", F.lit(False))).alias("apart"))
    open_quarters = quarters.where(F.col("long_term_debt").isNull()).select("ticker", F.col("period_end").alias("end"), "short_term_debt")
    at = q.join(lines, ["ticker", "accn", "tag"]).join(open_quarters, ["ticker", "end"])
    at = at.where((F.coalesce("short_term_debt", F.lit(0.0)) == 0) | F.col("tag").isin(*NONCURRENT_LINES) | F.col("apart"))
    one = at.groupBy("ticker", "end", "accn", "filed").agg(F.min("val").alias("lo"), F.max("val").alias("hi"), F.min("tag").alias("tag")).where("lo = hi")
    best = one.groupBy("ticker", "end").agg(F.max_by(F.struct("lo", "tag"), F.struct("filed", "accn")).alias("b"))
    return best.select("ticker", F.col("end").alias("period_end"), F.col("b.lo").alias("long_term_debt"), F.col("b.tag").alias("tag"))
