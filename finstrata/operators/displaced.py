"""Depreciation and amortisation totals that later filings show to be only a part (FCT-12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finstrata import registry as reg
from finstrata.operators.facts import PERIOD, agree
from finstrata.operators.periods import YEAR_DAYS
from finstrata.session import as_table

# The line that is no total, and amortisation shown beside it.
DEPRECIATION, AMORTIZATION = "Depreciation", ("AdjustmentForAmortization", "AmortizationOfIntangibleAssets")
TOTALS = [t for t in reg.TAGS["depreciation_amortization"] if t != DEPRECIATION]


def da_totals_displaced(facts: DataFrame) -> DataFrame:
    """*facts* less the totals under a tag that filings show to carry a part, the whole entered under that tag beside it.

    A filing shows it by repeating a period's total, which an earlier filing gave alone under another tag, with a
    smaller figure beside it. From then on the tag gives way wherever a filing has the other total beside it, larger
    and above the amortisation there, with no total of a higher rank; or has the tag alone beside a larger total
    that a filing gave the period by then. Of a year's periods to date all or none are read so, as their latest figures
    are. Everything is joined by company and period, so a company's filings are spread by period.
    """
    span = ["ticker", "start", "end"]
    t = facts.where(F.col("tag").isin(*TOTALS) & (F.col("unit") == "USD") & F.col("start").isNotNull()).groupBy(*PERIOD, "tag").agg(F.max("val").alias("val"), F.max("filed").alias("filed"))
    rank = F.array_position(F.array(*map(F.lit, TOTALS)), F.col("tag"))
    group = t.groupBy(*PERIOD).agg(F.min("filed").alias("when"), F.count("*").alias("n"), F.collect_set(rank).alias("ranks"))
    t = as_table(t.withColumn("rank", rank).join(group, PERIOD), "da-displaced")  # read many times over below
    o = t.select(*PERIOD, F.col("tag").alias("other"), F.col("val").alias("whole"), F.col("rank").alias("other_rank"))
    smaller = (F.col("val") < F.col("whole")) & ~agree(F.col("val"), F.col("whole"))
    beside = t.join(o, PERIOD).where((F.col("tag") != F.col("other")) & smaller)

    alone = t.where("n = 1").select(*span, F.col("tag").alias("other"), F.col("accn").alias("a2"), F.col("val").alias("v2"), F.col("filed").alias("f2"))
    shown = beside.join(alone, [*span, "other"]).where((F.col("a2") != F.col("accn")) & (F.col("f2") < F.col("when")) & agree(F.col("v2"), F.col("whole")))
    shown = shown.groupBy("ticker", "tag", "other").agg(F.min("when").alias("since"))

    judged = t.join(shown, ["ticker", "tag"]).where(F.col("since") <= F.col("when"))
    other_rank = F.array_position(F.array(*map(F.lit, TOTALS)), F.col("other"))
    outranked = F.exists("ranks", lambda r: (r < other_rank) & (r != F.col("rank")))
    judged = judged.where(~outranked).join(o.drop("other_rank"), [*PERIOD, "other"], "left")
    amortized = facts.where(F.col("tag").isin(*AMORTIZATION) & (F.col("unit") == "USD")).groupBy(*PERIOD).agg(F.max("val").alias("amortized"))
    with_whole = judged.where(F.col("whole").isNotNull() & smaller).join(amortized, PERIOD, "left").where(F.col("whole") > F.greatest(F.coalesce("amortized", F.lit(0.0)), F.lit(0.0)))
    given = t.select(*span, F.col("accn").alias("a2"), F.col("tag").alias("other"), F.col("val").alias("v2"), F.col("when").alias("f2"))
    on_its_own = judged.where(F.col("whole").isNull()).join(given, [*span, "other"]).where(
        (F.col("a2") != F.col("accn")) & (F.col("f2") <= F.col("when")) & (F.col("val") < F.col("v2")) & ~agree(F.col("val"), F.col("v2")))
    aside = with_whole.select(*PERIOD, "tag", "other").unionByName(on_its_own.select(*PERIOD, "tag", F.lit(None).cast("string").alias("other"))).distinct()

    year = F.datediff("end", "start") >= YEAR_DAYS[0]
    latest = t.where(~year).groupBy(*span, "tag").agg(F.max_by("accn", F.struct("filed", "accn")).alias("accn"))
    mixed = latest.join(aside.select(*PERIOD, "tag").distinct(), [*PERIOD, "tag"], "left_anti").select("ticker", "tag", "start").distinct().withColumn("mixed", F.lit(True))
    aside = aside.join(mixed, ["ticker", "tag", "start"], "left").where(F.col("mixed").isNull() | year).drop("mixed")
    aside = as_table(aside, "da-aside")

    out = facts.join(aside.select(*PERIOD, "tag").distinct(), [*PERIOD, "tag"], "left_anti")
    copies = facts.withColumnRenamed("tag", "other").join(aside.where(F.col("other").isNotNull()), [*PERIOD, "other"]).select(*facts.columns).distinct()
    return out.unionByName(copies)
