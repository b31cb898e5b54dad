"""Data-quality checks (DQ-1..15): findings are rows (ticker, period, severity, code, message)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finstrata import registry as reg
from finstrata.functions.scale import exact_percentiles
from finstrata.operators.periods import derive_identities

# Penalties, required fields, tolerances and bounds of the checks.
PENALTY = {"high": 25, "medium": 10, "low": 3, "info": 0}
CORE = "revenue net_income total_assets total_liabilities total_equity operating_cash_flow".split()
REQUIRED = {"bank": CORE + ["net_interest_income", "total_deposits"], "insurance": CORE + ["premiums_earned"]}
OUTFLOWS = "capex dividends_paid share_repurchases debt_repaid".split()
BALANCE_TOLERANCE, GROSS_PROFIT_TOLERANCE, MATERIALITY = 0.02, 0.01, 1_000_000.0
OUTLIER_FACTOR, CASH_TOLERANCE, CASH_GROSS_TOLERANCE, QUARTERLY_TOLERANCE = 100.0, 0.01, 0.05, 0.01
GAP_FACTOR, SHORTFALL, MIN_INTERVALS, EQUITY_FLOOR = 1.7, 0.8, 4, 0.05
LUMPY = ("debt_issued debt_repaid share_repurchases acquisitions restructuring impairment cash_from_discontinued_operations "
         "discontinued_operating_cash_flow discontinued_investing_cash_flow discontinued_financing_cash_flow").split()
OUTLIER_EXCLUDED = LUMPY + "net_change_in_cash fx_effect_on_cash short_term_debt".split()
# Ratio -> (lowest, highest) allowed; None leaves a side open. The efficiency ratio's low end is excluded.
BOUNDS = {"gross_margin": (None, 1.01), "operating_margin": (None, 1.01), "ebitda_margin": (None, 1.01), "net_margin": (-2.0, 2.0),
          "fcf_margin": (-2.0, 2.0), "roe": (-5.0, 5.0), "roa": (-5.0, 5.0), "roic": (-5.0, 5.0), "efficiency_ratio": (0.0, 2.0),
          "loss_ratio": (0.0, 3.0), "combined_ratio": (0.0, 3.0), "loan_to_deposit": (0.0, 5.0), "ffo_payout": (0.0, 5.0),
          "net_interest_margin": (0.0, 0.25)}


def scored(annual: DataFrame, years: int = 5) -> DataFrame:
    """The latest *years* fiscal years of each company."""
    w = Window.partitionBy("ticker").orderBy(F.desc("fiscal_year"))
    return annual.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= years).drop("__k")


def _findings(df: DataFrame, items: list[tuple[Column, str, str, Column]]) -> DataFrame:
    """Explodes (condition, severity, code, message) checks of one row into finding rows."""
    arr = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(s).alias("severity"), F.lit(k).alias("code"), m.alias("message")))
                                    for c, s, k, m in items]))
    return (df.select("ticker", F.col("fiscal_year").alias("period"), F.explode(arr).alias("f"))
            .select("ticker", "period", "f.severity", "f.code", "f.message"))


def _num(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("double")


def required_fields(annual: DataFrame, years: int = 5) -> DataFrame:
    a = scored(annual, years)
    names = sorted({f for fs in REQUIRED.values() for f in fs} | set(CORE))
    items = []
    for n in names:
        wanted = F.lit(True) if n in CORE else F.col("sector_class").isin([s for s, fs in REQUIRED.items() if n in fs])
        items.append((wanted & _num(a, n).isNull(), "medium", "missing_field", F.lit(f"Missing required field '{n}'.")))
    return _findings(a, items)


def balance_identity(annual: DataFrame, years: int = 5, derived: Column | None = None) -> DataFrame:
    """Assets against liabilities + equity + minority interest, where liabilities are reported."""
    a = scored(annual, years)
    assets, right = F.col("total_assets"), F.col("total_liabilities") + F.col("total_equity") + F.coalesce(_num(a, "minority_interest"), F.lit(0.0))
    off = F.abs(assets - right) / F.nullif(F.abs(assets), F.lit(0.0)) > BALANCE_TOLERANCE
    if derived is not None:
        off = off & ~derived
    return _findings(a, [(off, "medium", "balance_sheet_imbalance", F.format_string(
        "Assets (%,.0f) != Liabilities + Equity + NCI (%,.0f).", assets, right))])


def row_sanity(annual: DataFrame, years: int = 5) -> DataFrame:
    """Gross-profit mismatch, negative outflows, negative revenue, implausible EPS."""
    a = scored(annual, years)
    rev = F.col("revenue")
    mismatch = F.abs(F.col("gross_profit") - (rev - F.col("cost_of_revenue"))) / F.nullif(F.abs(rev), F.lit(0.0)) > GROSS_PROFIT_TOLERANCE
    items = [(mismatch, "low", "gross_profit_mismatch", F.lit("Gross profit != revenue - cost of revenue."))]
    items += [(_num(a, n) < 0, "low", "unexpected_sign", F.format_string(f"'{n}' is negative (%,.0f); expected a magnitude.", _num(a, n))) for n in OUTFLOWS]
    items += [(rev < 0, "low", "negative_revenue", F.format_string("Revenue is negative (%,.0f).", rev))]
    items += [(F.abs(_num(a, n)) > 1000, "low", "implausible_eps", F.format_string(f"'{n}' = %s is outside a plausible range.", _num(a, n).cast("string")))
              for n in ("eps_basic", "eps_diluted")]
    return _findings(a, items)


def revenue_discontinuity(annual: DataFrame, years: int = 5, fall: float = -0.9, rise: float = 5.0) -> DataFrame:
    w = Window.partitionBy("ticker").orderBy("fiscal_year")
    a = scored(annual, years).withColumns({"__p": F.lag("revenue").over(w), "__py": F.lag("fiscal_year").over(w)})
    change = F.when((F.col("__p") > 0) & (F.col("revenue") != 0), F.col("revenue") / F.nullif(F.col("__p"), F.lit(0.0)) - 1)
    return _findings(a, [((change < fall) | (change > rise), "info", "revenue_discontinuity", F.format_string(
        "Revenue changed %+.0f%% from %d to %d.", change * 100, F.col("__py"), F.col("fiscal_year")))])


def quality_score(findings: DataFrame, companies: DataFrame) -> DataFrame:
    """(ticker, score): 100 less the findings' penalties, never below 0."""
    penalty = F.coalesce(*[F.when(F.col("severity") == s, F.lit(p)) for s, p in PENALTY.items()], F.lit(0))
    g = findings.groupBy("ticker").agg(F.sum(penalty).alias("__p"))
    return companies.select("ticker").join(g, "ticker", "left").select(
        "ticker", F.greatest(F.lit(0), 100 - F.coalesce("__p", F.lit(0))).cast("int").alias("score"))


def magnitude_outliers(annual: DataFrame, fields: list[str], years: int = 5, factor: float = OUTLIER_FACTOR,
                       materiality: float = MATERIALITY) -> DataFrame:
    """A figure at least *factor* times both its non-zero neighbours of the same field."""
    use = [f for f in fields if f not in OUTLIER_EXCLUDED]
    keep = scored(annual, years).select("ticker", "fiscal_year").withColumn("__scored", F.lit(True))
    long = annual.unpivot(["ticker", "fiscal_year"], use, "field", "value").where(F.col("value") != 0)
    w = Window.partitionBy("ticker", "field").orderBy("fiscal_year")
    m = F.abs("value")
    d = long.withColumns({"__a": F.lag(m).over(w), "__b": F.lead(m).over(w)}).join(keep, ["ticker", "fiscal_year"])
    hit = d.where((m >= materiality) & (m >= factor * F.col("__a")) & (m >= factor * F.col("__b")))
    return hit.select("ticker", F.col("fiscal_year").alias("period"), F.lit("high").alias("severity"), F.lit("magnitude_outlier").alias("code"),
                      F.format_string("'%s' = %,.0f spikes to %.0fx the prior year and %.0fx the next; likely a one-off filing or tag error.",
                                      "field", "value", m / F.col("__a"), m / F.col("__b")).alias("message"), "field")


def cashflow_reconciliation(annual: DataFrame, years: int = 5, materiality: float = MATERIALITY) -> DataFrame:
    """Net change in cash against the three sections plus FX, on neither discontinued-operations basis."""
    a = scored(annual, years)
    net, o, i, f = (F.col(c) for c in ("net_change_in_cash", "operating_cash_flow", "investing_cash_flow", "financing_cash_flow"))
    expected = o + i + f + F.coalesce(_num(a, "fx_effect_on_cash"), F.lit(0.0))
    other = expected + F.coalesce(_num(a, "cash_from_discontinued_operations"), F.lit(0.0))
    gross = F.abs(o) + F.abs(i) + F.abs(f)

    def off(e: Column) -> Column:
        r = F.abs(net - e)
        return (r > CASH_TOLERANCE * F.greatest(F.abs(net), F.abs(e))) & (r > CASH_GROSS_TOLERANCE * gross)

    bad = (F.greatest(F.abs(net), F.abs(expected)) >= materiality) & (net + o + i + f).isNotNull() & off(expected) & off(other)
    return _findings(a, [(bad, "medium", "cashflow_imbalance", F.format_string(
        "reported net change in cash (%,.0f) != operating+investing+financing+FX (%,.0f); residual %,.0f.", net, expected, net - expected))])


def quarterly_sums(annual: DataFrame, quarterly: DataFrame, fields: list[str], years: int = 5, materiality: float = MATERIALITY) -> DataFrame:
    """Fields whose four quarters, all present, do not sum to the year within one percent."""
    use = [f for f in fields if f not in LUMPY]
    q = quarterly.where(F.col("fiscal_quarter").between(1, 4)).groupBy("ticker", "fiscal_year").agg(
        F.countDistinct("fiscal_quarter").alias("__q"),
        *[F.when(F.count(c) == 4, F.sum(c)).alias(f"__{c}") for c in use]).where(F.col("__q") == 4)
    a = scored(annual, years).select("ticker", "fiscal_year", *use).join(q, ["ticker", "fiscal_year"])
    bad = F.array_compact(F.array(*[F.when((F.abs(F.col(c)) >= materiality) & (
        F.abs(F.col(f"__{c}") - F.col(c)) / F.nullif(F.abs(F.col(c)), F.lit(0.0)) > QUARTERLY_TOLERANCE), F.lit(c)) for c in use]))
    d = a.withColumn("__bad", bad)
    preview = F.concat(F.array_join(F.slice("__bad", 1, 5), ", "), F.when(F.size("__bad") > 5, ", ...").otherwise(""))
    return _findings(d, [(F.size("__bad") > 0, "medium", "quarterly_sum_mismatch", F.format_string(
        "FY%d: %d flow field(s) whose four quarters don't sum to the annual figure (%s).", F.col("fiscal_year"), F.size("__bad"), preview))])


def ratio_bounds(ratios: DataFrame, years: int = 5) -> DataFrame:
    """Ratios outside their plausible range; return on equity or capital only on a sound equity base.

    *ratios* also carries total_equity and total_assets.
    """
    a = scored(ratios, years)
    weak = (F.col("total_equity") <= 0) | (F.abs("total_equity") < EQUITY_FLOOR * F.abs("total_assets"))
    items = []
    for n, (lo, hi) in BOUNDS.items():
        v = _num(a, n)
        tests = ([v < lo] if lo is not None and n != "efficiency_ratio" else [v <= lo] if lo is not None else []) + [v > hi]
        bad = reduce(lambda x, y: x | y, tests)
        if n in ("roe", "roic"):
            bad = bad & ~F.coalesce(weak, F.lit(False))
        items.append((bad, "low", "ratio_out_of_bounds", F.format_string(f"'{n}' = %.4f is outside its plausible range.", v)))
    return _findings(a, items)


def dividend_gaps(annual: DataFrame, dividends: DataFrame, splits: DataFrame, years: int = 5) -> DataFrame:
    """Fiscal years whose payments miss what is declared: a gap in the schedule and a total short of the declared figure.

    Years with a later split are skipped; a year without a declared figure is measured against the year before's.
    """
    w = Window.partitionBy("ticker").orderBy("date")
    p = dividends.select("ticker", "date", "amount").withColumn("__next", F.lead("date").over(w))
    step = F.datediff("__next", "date")
    usual = p.where(F.col("__next").isNotNull()).groupBy("ticker").agg(F.percentile(step, 0.5).alias("usual"), F.count("*").alias("__n")).where(F.col("__n") >= MIN_INTERVALS)
    wy = Window.partitionBy("ticker").orderBy("fiscal_year").rangeBetween(-1, -1)
    y = annual.withColumns({"__pd": F.max("dividends_per_share").over(wy), "__pe": F.max("period_end").over(wy)})
    y = scored(y, years).where(F.col("period_end").isNotNull()).select("ticker", "fiscal_year", "period_end", "dividends_per_share", "__pd", "__pe")
    y = y.join(usual.drop("__n"), "ticker").withColumn("start", F.date_sub("period_end", 365))
    paid = y.select("ticker", "fiscal_year", "start", "period_end").join(p, "ticker").where((F.col("date") > F.col("start")) & (F.col("date") <= F.col("period_end")))
    y = y.join(paid.groupBy("ticker", "fiscal_year").agg(F.sum("amount").alias("__total")), ["ticker", "fiscal_year"], "left")
    total = F.coalesce("__total", F.lit(0.0))
    before = F.col("dividends_per_share").isNull() & (total > 0) & (F.col("__pe") < F.col("period_end"))
    y = y.withColumns({"total": total, "declared": F.coalesce("dividends_per_share", F.when(before, F.col("__pd"))),
                       "__ref": F.when(before, F.date_sub("__pe", 365)).otherwise(F.col("start"))})
    last_split = splits.groupBy("ticker").agg(F.max("date").alias("__split"))
    y = y.join(last_split, "ticker", "left").where((F.col("declared") > 0) & (F.col("__split").isNull() | (F.col("__split") <= F.col("__ref"))))
    gaps = p.join(usual.drop("__n"), "ticker").where(step > GAP_FACTOR * F.col("usual")).select("ticker", F.col("date").alias("a"), F.col("__next").alias("b"))
    # Few gaps per company: each exceeds 1.7 usual intervals.
    recent = F.datediff("start", "a") <= GAP_FACTOR * F.col("usual")
    j = y.join(gaps, "ticker").where(recent & (F.col("a") < F.col("period_end")) & (F.col("b") > F.col("start")))
    g = j.groupBy("ticker", "fiscal_year", "total", "declared", "usual").agg(F.min(F.struct("a", "b")).alias("g"))
    return g.where(F.col("total") < SHORTFALL * F.col("declared")).select(
        "ticker", "fiscal_year", F.col("g.a").alias("gap_from"), F.col("g.b").alias("gap_to"), "total", "declared", "usual")


def field_fill_rates(annual: DataFrame, fields: list[str], by: str | None = None) -> DataFrame:
    """Share of the latest annual rows that have each field, overall or per *by*."""
    last = annual.groupBy("ticker").agg(F.max("fiscal_year").alias("fiscal_year"))
    rows = annual.join(last, ["ticker", "fiscal_year"], "left_semi")
    keys = [by] if by else []
    g = rows.groupBy(*keys).agg(F.count("*").alias("rows"), *[F.avg(F.col(f).isNotNull().cast("int")).alias(f) for f in fields])
    return g.unpivot([*keys, "rows"], fields, "field", "fill_rate")


#: The line items a sector has of its own, by the registry.
SECTOR_CORE = {sector: [r[0] for r in reg.ROWS if sector in r[5].split()] for sector in ("bank", "insurance", "reit")}


def coverage_status(annual: DataFrame, fields: list[str]) -> DataFrame:
    """(ticker, sector_class, fiscal_year, field, status) of each company's latest year: reported, derived from other items, or empty."""
    last = annual.groupBy("ticker").agg(F.max("fiscal_year").alias("fiscal_year"))
    a = annual.join(last, ["ticker", "fiscal_year"], "left_semi")
    d = derive_identities(a)
    status = lambda f: F.when(F.col(f).isNull(), "empty").when(F.array_contains("derived", f), "derived").otherwise("reported")
    wide = d.select("ticker", "sector_class", "fiscal_year", *[status(f).alias(f) for f in fields if f in d.columns], *[F.lit("empty").alias(f) for f in fields if f not in d.columns])
    return wide.unpivot(["ticker", "sector_class", "fiscal_year"], fields, "field", "status")


def _with_core(status: DataFrame) -> DataFrame:
    own = F.lit(False)
    for sector, items in SECTOR_CORE.items():
        own = own | ((F.col("sector_class") == sector) & F.col("field").isin(*items))
    return status.withColumns({"__core": F.col("field").isin(*CORE), "__own": own, "__filled": (F.col("status") != "empty").cast("int")})


def coverage(annual: DataFrame, fields: list[str]) -> DataFrame:
    """Per company: how many fields of the latest year are reported, derived and empty, and the gaps in the universal and its sector's core."""
    s = _with_core(coverage_status(annual, fields))
    count = lambda k: F.sum((F.col("status") == k).cast("int")).cast("int").alias(k)
    gaps = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(F.col(c) & (F.col("__filled") == 0), F.col("field")))), ", ")
    return s.groupBy("ticker", "sector_class", "fiscal_year").agg(count("reported"), count("derived"), count("empty"), gaps("__core").alias("core_gaps"), gaps("__own").alias("sector_gaps"))


def coverage_rates(annual: DataFrame, fields: list[str]) -> DataFrame:
    """(scope, field, companies, fill_rate): the universal core over all companies, each sector's core over its own."""
    s = _with_core(coverage_status(annual, fields))
    rate = [F.count("*").alias("companies"), F.avg("__filled").alias("fill_rate")]
    every = s.where("__core").groupBy(F.lit("universal").alias("scope"), "field").agg(*rate)
    return every.unionByName(s.where("__own").groupBy(F.col("sector_class").alias("scope"), "field").agg(*rate))


def latest_runs(runs: DataFrame) -> DataFrame:
    cols = [c for c in runs.columns if c != "ticker"]
    return runs.groupBy("ticker").agg(F.max_by(F.struct(*cols), F.struct("collected_at", "run_id")).alias("r")).select("ticker", "r.*")


def coverage_by_sector(runs: DataFrame, companies: DataFrame) -> DataFrame:
    """Companies and exact median quality of the latest runs per sector."""
    j = companies.join(latest_runs(runs).select("ticker", "quality_score"), "ticker", "left")
    n = j.groupBy("sector_class").agg(F.count("*").alias("n"))
    m = exact_percentiles(j.withColumn("quality_score", F.col("quality_score").cast("double")), ["sector_class"], "quality_score", {"median_quality": 0.5})
    return n.join(m, "sector_class", "left")


def unmapped_top(unmapped: DataFrame, limit: int | None = None) -> DataFrame:
    g = unmapped.groupBy("tag").agg(F.countDistinct("ticker").alias("companies"), F.max("label").alias("label"), F.count("*").alias("facts"))
    g = g.orderBy(F.desc("companies"), F.desc("facts"), "tag")
    return g if limit is None else g.limit(limit)


def freshness(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(name, rows, latest) of each stored table by its date column."""
    parts = [df.agg(F.count("*").alias("rows"), F.max(c).cast("date").alias("latest")).select(F.lit(n).alias("name"), "rows", "latest") for n, (df, c) in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)
