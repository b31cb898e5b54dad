"""DQ, QRY and SCR."""

from pyspark.sql import functions as F

from finstrata.operators import companies as c
from finstrata.operators import quality as q
from finstrata.operators import ratios as rat
from finstrata.operators import screener as s
from finstrata.operators import valuation as v
from finstrata.plans import standin
from finstrata.plans.catalog import b_ratios as B
from finstrata.plans.catalog import c_history as H
from finstrata.plans.catalog import d_valuation as D
from finstrata.plans.catalog import e_scores as S
from finstrata.plans.catalog import g_ownership as O
from finstrata.plans.catalog._core import query

R = standin.RELATIONS
R["ox_acal"] = "SELECT a.*, sector_class, row_number() OVER (PARTITION BY a.ticker ORDER BY fiscal_year DESC) AS rn FROM si_annual_cal a JOIN si_company c ON a.ticker = c.ticker"


def annual(u):
    return u.annual_cal.join(u.company.select("ticker", "sector_class"), "ticker")


_F = ["ticker", "period", "severity", "code"]


def _req(n):
    if n in q.CORE:
        return "true"
    return "sector_class IN (" + ", ".join(repr(k) for k, fs in q.REQUIRED.items() if n in fs) + ")"


_NAMES = sorted({f for fs in q.REQUIRED.values() for f in fs})


@query("dq1_required_fields", " UNION ALL ".join(f"SELECT ticker, fiscal_year AS period, 'medium' AS severity, 'Missing required field ''{n}''.' AS message FROM ox_acal WHERE rn <= 5 AND {n} IS NULL AND {_req(n)}" for n in _NAMES))
def dq1(u):
    return q.required_fields(annual(u)).select("ticker", "period", "severity", "message")


@query("dq2_balance_identity", "SELECT ticker, fiscal_year AS period, 'medium' AS severity, 'balance_sheet_imbalance' AS code FROM ox_acal WHERE rn <= 5 AND total_assets <> 0 AND abs(total_assets - (total_liabilities + total_equity)) / abs(total_assets) > 0.02")
def dq2(u):
    return q.balance_identity(annual(u)).select(*_F)


_SANE = "SELECT * REPLACE (CASE WHEN revenue % 5 = 0 THEN gross_profit * 1.5 ELSE gross_profit END AS gross_profit, CASE WHEN revenue % 7 = 0 THEN -capex ELSE capex END AS capex, eps_diluted * 50 AS eps_diluted) FROM ox_acal"


@query("dq3_row_sanity", f"SELECT ticker, fiscal_year AS period, code FROM (SELECT *, unnest([CASE WHEN abs(gross_profit - (revenue - cost_of_revenue)) / abs(revenue) > 0.01 THEN 'gross_profit_mismatch' END, CASE WHEN capex < 0 THEN 'unexpected_sign' END, CASE WHEN abs(eps_diluted) > 1000 THEN 'implausible_eps' END]) AS code FROM ({_SANE}) s WHERE rn <= 5) x WHERE code IS NOT NULL")
def dq3(u):
    a = annual(u).withColumns({"gross_profit": F.when(F.col("revenue") % 5 == 0, F.col("gross_profit") * 1.5).otherwise(F.col("gross_profit")),
                               "capex": F.when(F.col("revenue") % 7 == 0, -F.col("capex")).otherwise(F.col("capex")), "eps_diluted": F.col("eps_diluted") * 50})
    return q.row_sanity(a).select("ticker", "period", "code")


@query("dq4_revenue_discontinuity", "SELECT ticker, fiscal_year AS period FROM (SELECT *, lag(revenue) OVER (PARTITION BY ticker ORDER BY fiscal_year) AS p FROM ox_acal WHERE rn <= 5) x WHERE revenue / p - 1 < -0.1 OR revenue / p - 1 > 0.2")
def dq4(u):
    return q.revenue_discontinuity(annual(u), 5, -0.1, 0.2).select("ticker", "period")


@query("dq5_quality_score", "SELECT c.ticker, CAST(greatest(0, 100 - 10 * (SELECT count(*) FROM ox_acal a WHERE a.ticker = c.ticker AND rn <= 5 AND total_assets <> 0 AND abs(total_assets - (total_liabilities + total_equity)) / abs(total_assets) > 0.02) - 10 * (SELECT count(*) FROM ox_acal a WHERE a.ticker = c.ticker AND rn <= 5 AND total_liabilities IS NULL)) AS INT) AS score FROM si_company c")
def dq5(u):
    a = annual(u)
    f = q.balance_identity(a).unionByName(q.required_fields(a).where(F.col("message").contains("total_liabilities")))
    return q.quality_score(f, u.company)


_OUT = ["capex", "interest_expense", "net_income", "operating_cash_flow", "dividends_paid"]


@query("dq6_magnitude_outliers", "SELECT ticker, fiscal_year AS period, field FROM (" + " UNION ALL ".join(f"SELECT ticker, fiscal_year, '{f}' AS field, abs({f}) AS m, lag(abs({f})) OVER w AS a, lead(abs({f})) OVER w AS b FROM si_annual WHERE {f} <> 0 WINDOW w AS (PARTITION BY ticker ORDER BY fiscal_year)" for f in _OUT) + ") x WHERE m >= 1000 AND m >= 1.4 * a AND m >= 1.4 * b AND fiscal_year > (SELECT max(fiscal_year) FROM si_annual z WHERE z.ticker = x.ticker) - 8")
def dq6(u):
    return q.magnitude_outliers(u.annual, _OUT, 8, 1.4, 1000.0).select("ticker", "period", "field")


@query("dq7_cashflow_reconciliation", "SELECT ticker, fiscal_year AS period FROM (SELECT *, operating_cash_flow + investing_cash_flow + financing_cash_flow AS e, abs(operating_cash_flow) + abs(investing_cash_flow) + abs(financing_cash_flow) AS g FROM ox_acal WHERE rn <= 5) x WHERE greatest(abs(net_change_in_cash), abs(e)) >= 1000 AND abs(net_change_in_cash - e) > 0.01 * greatest(abs(net_change_in_cash), abs(e)) AND abs(net_change_in_cash - e) > 0.05 * g")
def dq7(u):
    return q.cashflow_reconciliation(annual(u), 5, 1000.0).select("ticker", "period")


_QS = ["revenue", "net_income", "capex", "operating_cash_flow", "sga_expense"]


@query("dq8_quarterly_sums", "SELECT ticker, period, n FROM (SELECT a.ticker, a.fiscal_year AS period, " + " + ".join(f"coalesce(CASE WHEN n_{f} = 4 AND abs(a.{f} * 1.0) >= 1000 THEN (abs(s_{f} - a.{f}) / abs(a.{f}) > 0.01)::INT END, 0)" for f in _QS) + " AS n FROM (SELECT * REPLACE (CASE WHEN fiscal_year % 2 = 0 THEN revenue * 1.02 ELSE revenue END AS revenue, CASE WHEN fiscal_year % 3 = 0 THEN capex * 0.9 ELSE capex END AS capex) FROM ox_acal) a JOIN (SELECT ticker, fiscal_year, count(DISTINCT fiscal_quarter) AS nq, " + ", ".join(f"count({f}) AS n_{f}, sum({f}) AS s_{f}" for f in _QS) + " FROM si_quarterly GROUP BY ALL) q ON q.ticker = a.ticker AND q.fiscal_year = a.fiscal_year WHERE rn <= 5 AND nq = 4) x WHERE n > 0")
def dq8(u):
    a = annual(u).withColumns({"revenue": F.when(F.col("fiscal_year") % 2 == 0, F.col("revenue") * 1.02).otherwise(F.col("revenue")),
                               "capex": F.when(F.col("fiscal_year") % 3 == 0, F.col("capex") * 0.9).otherwise(F.col("capex"))})
    return q.quarterly_sums(a, u.quarterly, _QS, 5, 1000.0).select("ticker", "period", F.regexp_extract("message", r": (\d+) flow", 1).cast("int").alias("n"))


def ratio_rows(u):
    return u.shared("ratio_rows", lambda: rat.ratios(annual(u), keep=["ticker", "fiscal_year", "sector_class", "total_equity", "total_assets"]).drop("basis"))


_B = [("net_margin", "abs(net_margin) > 2"), ("roe", "abs(roe) > 5 AND NOT weak"), ("roic", "abs(roic) > 5 AND NOT weak"), ("efficiency_ratio", "efficiency_ratio <= 0 OR efficiency_ratio > 2"),
      ("loss_ratio", "loss_ratio < 0 OR loss_ratio > 3"), ("loan_to_deposit", "loan_to_deposit < 0 OR loan_to_deposit > 5"), ("ffo_payout", "ffo_payout < 0 OR ffo_payout > 5"), ("net_interest_margin", "net_interest_margin < 0 OR net_interest_margin > 0.25")]
_RR = "SELECT a.*, " + ", ".join(x for x in B._overlay("x") if not any(f" AS {m}" in x for m in B._MARKET)) + " FROM ox_acal a"


@query("dq9_ratio_bounds", f"SELECT ticker, fiscal_year AS period, metric FROM (SELECT *, unnest([{', '.join(f'''CASE WHEN {t} THEN '{n}' END''' for n, t in _B)}]) AS metric FROM (SELECT *, coalesce(total_equity <= 0 OR abs(total_equity) < 0.05 * abs(total_assets), false) AS weak FROM ({_RR}) r WHERE rn <= 5) w) x WHERE metric IS NOT NULL")
def dq9(u):
    return q.ratio_bounds(ratio_rows(u)).select("ticker", "period", F.regexp_extract("message", "^'(.+)'", 1).alias("metric"))


R["ox_gapyears"] = "SELECT a.ticker, a.fiscal_year, a.period_end, a.period_end - 365 AS start, CASE WHEN fiscal_year % 3 = 0 THEN NULL ELSE dividends_per_share END AS dps, lag(CASE WHEN fiscal_year % 3 = 0 THEN NULL ELSE dividends_per_share END) OVER (PARTITION BY ticker ORDER BY fiscal_year) AS pd, lag(period_end) OVER (PARTITION BY ticker ORDER BY fiscal_year) AS pe, rn FROM ox_acal a"


@query("dq10_dividend_gaps", """SELECT y.ticker, y.fiscal_year, min(g.a) AS gap_from, arg_min(g.b, g.a) AS gap_to, y.total, y.declared, y.usual FROM (
 SELECT x.*, u.usual, coalesce(dps, CASE WHEN before THEN pd END) AS declared, CASE WHEN before THEN pe - 365 ELSE start END AS ref FROM (SELECT x.*, dps IS NULL AND total > 0 AND pe < period_end AS before FROM (SELECT y.*, coalesce((SELECT sum(amount) FROM si_dividends d WHERE d.ticker = y.ticker AND d.date > y.start AND d.date <= y.period_end), 0) AS total FROM ox_gapyears y WHERE rn <= 5) x) x
 JOIN (SELECT ticker, median(st) AS usual FROM (SELECT ticker, date_diff('day', date, lead(date) OVER (PARTITION BY ticker ORDER BY date)) AS st FROM si_dividends) z GROUP BY ticker HAVING count(st) >= 4) u ON u.ticker = x.ticker) y
 JOIN (SELECT ticker, date AS a, lead(date) OVER (PARTITION BY ticker ORDER BY date) AS b FROM si_dividends) g ON g.ticker = y.ticker AND date_diff('day', g.a, g.b) > 1.7 * y.usual AND date_diff('day', g.a, y.start) <= 1.7 * y.usual AND g.a < y.period_end AND g.b > y.start
 WHERE declared > 0 AND total < 0.8 * declared AND NOT EXISTS (SELECT 1 FROM si_splits s WHERE s.ticker = y.ticker AND s.date > y.ref) GROUP BY y.ticker, y.fiscal_year, y.total, y.declared, y.usual""", r="total declared usual")
def dq10(u):
    a = u.annual_cal.withColumn("dividends_per_share", F.when(F.col("fiscal_year") % 3 != 0, F.col("dividends_per_share")))
    return q.dividend_gaps(a, u.dividends, u.splits)


_FILL = ["capex", "goodwill", "long_term_debt", "dividends_paid", "total_loans", "commercial_paper"]


@query("dq11_field_fill_rates", " UNION ALL ".join(f"SELECT sector_class, count(*) AS rows, '{f}' AS field, avg(({f} IS NOT NULL)::INT) AS fill_rate FROM ox_acal WHERE rn = 1 GROUP BY sector_class" for f in _FILL), r="fill_rate")
def dq11(u):
    return q.field_fill_rates(annual(u), _FILL, "sector_class")


# Total liabilities are left to be derived in odd companies, net interest income is missing in every third.
_COVER = [*q.CORE, *[f for items in q.SECTOR_CORE.values() for f in items], "capex", "goodwill"]
_HAS = set("revenue net_income total_assets total_liabilities total_equity operating_cash_flow net_interest_income noninterest_income noninterest_expense total_deposits total_loans premiums_earned claims_incurred benefits_and_expenses capex goodwill".split())
R["ox_cover"] = "SELECT * REPLACE (CASE WHEN CAST(substr(ticker, 2) AS INT) % 2 = 0 THEN total_liabilities END AS total_liabilities, CASE WHEN CAST(substr(ticker, 2) AS INT) % 3 > 0 THEN net_interest_income END AS net_interest_income) FROM ox_acal WHERE rn = 1"
_ST = lambda f: (f"CASE WHEN total_liabilities IS NOT NULL THEN 'reported' WHEN total_assets - total_equity IS NOT NULL THEN 'derived' ELSE 'empty' END" if f == "total_liabilities"
                 else "CASE WHEN revenue IS NOT NULL THEN 'reported' WHEN net_interest_income + noninterest_income IS NOT NULL THEN 'derived' ELSE 'empty' END" if f == "revenue"
                 else f"CASE WHEN {f} IS NOT NULL THEN 'reported' ELSE 'empty' END" if f in _HAS else "'empty'")
R["ox_coverlong"] = " UNION ALL ".join(f"SELECT ticker, sector_class, fiscal_year, '{f}' AS field, {_ST(f)} AS status, {str(f in q.CORE).lower()} AS core, {'sector_class = ' + repr(next(k for k, v in q.SECTOR_CORE.items() if f in v)) if any(f in v for v in q.SECTOR_CORE.values()) else 'false'} AS own FROM ox_cover" for f in _COVER)


def _cover(u):
    n = F.substring("ticker", 2, 9).cast("int")
    return annual(u).withColumns({"total_liabilities": F.when(n % 2 == 0, F.col("total_liabilities")), "net_interest_income": F.when(n % 3 > 0, F.col("net_interest_income"))})


@query("dq12_coverage", "SELECT ticker, sector_class, fiscal_year, " + ", ".join(f"CAST(count(*) FILTER (status = '{k}') AS INT) AS {k}" for k in ("reported", "derived", "empty")) + ", coalesce(string_agg(field, ', ' ORDER BY field) FILTER (core AND status = 'empty'), '') AS core_gaps, coalesce(string_agg(field, ', ' ORDER BY field) FILTER (own AND status = 'empty'), '') AS sector_gaps FROM ox_coverlong GROUP BY ticker, sector_class, fiscal_year")
def dq12(u):
    return q.coverage(_cover(u), _COVER)


@query("dq12_coverage_rates", "SELECT 'universal' AS scope, field, count(*) AS companies, avg((status <> 'empty')::INT) AS fill_rate FROM ox_coverlong WHERE core GROUP BY field UNION ALL SELECT sector_class, field, count(*), avg((status <> 'empty')::INT) FROM ox_coverlong WHERE own GROUP BY sector_class, field", r="fill_rate")
def dq12r(u):
    return q.coverage_rates(_cover(u), _COVER)


R["si_runs"] = "SELECT concat('S', l_suppkey) AS ticker, CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS collected_at, max(l_orderkey) AS run_id, CAST(100 - min(l_linenumber) * 3 - CAST(count(*) AS INT) % 20 AS INT) AS quality_score FROM lineitem GROUP BY l_suppkey, date_trunc('month', l_shipdate)"
R["ox_lruns"] = "SELECT ticker, arg_max(quality_score, collected_at) AS quality_score, max(collected_at) AS collected_at FROM si_runs GROUP BY ticker"


@query("dq13_coverage_by_sector", "SELECT sector_class, count(*) AS n, median(quality_score) AS median_quality FROM si_company c LEFT JOIN ox_lruns r ON r.ticker = c.ticker GROUP BY sector_class")
def dq13(u):
    return q.coverage_by_sector(u.runs, u.company)


R["si_unmapped"] = "SELECT concat('S', l_suppkey) AS ticker, p_name AS tag, concat(p_brand, ' ', p_type) AS label, CAST(l_shipdate AS DATE) AS \"end\", CAST(floor(l_extendedprice) AS DOUBLE) AS val FROM lineitem JOIN part ON l_partkey = p_partkey"


@query("dq14_unmapped_top", "SELECT tag, count(DISTINCT ticker) AS companies, max(label) AS label, count(*) AS facts FROM si_unmapped GROUP BY tag")
def dq14(u):
    return q.unmapped_top(u.unmapped)


@query("dq15_freshness", "SELECT 'bars' AS name, count(*) AS rows, max(date) AS latest FROM si_bars UNION ALL SELECT 'runs', count(*), CAST(max(collected_at) AS DATE) FROM si_runs UNION ALL SELECT 'dividends', count(*), max(date) FROM si_dividends")
def dq15(u):
    return q.freshness({"bars": (u.bars, "date"), "runs": (u.runs, "collected_at"), "dividends": (u.dividends, "date")})


# ---- QRY

@query("qry1_list_companies", "SELECT ticker, company_name, sector_class FROM si_company WHERE sector_class = 'general' AND contains(upper(company_name), '0') ORDER BY ticker LIMIT 20 OFFSET 5")
def qry1(u):
    return c.list_companies(u.company, "general", "0", 20, 5).select("ticker", "company_name", "sector_class")


@query("qry1_count_companies", "SELECT count(*) AS n FROM si_company WHERE sector_class = 'bank'")
def qry1c(u):
    return c.count_companies(u.company, "bank")


@query("qry2_search_hits", "SELECT ticker, company_name, CAST(CASE WHEN ticker = 'S1' THEN 0 WHEN starts_with(ticker, 'S1') THEN 1 ELSE 2 END AS INT) AS rank FROM si_company WHERE contains(ticker, 'S1') OR contains(upper(company_name), 'S1')")
def qry2(u):
    return c.search_hits(u.company, "s1")


@query("qry2_sectors", "SELECT DISTINCT sector_class FROM si_company")
def qry2s(u):
    return c.sectors(u.company)


@query("qry2_sic_codes", "SELECT ticker, sic, sic_description FROM si_company")
def qry2c(u):
    return c.sic_codes(u.company)


@query("qry3_overview", "SELECT c.ticker, s.at AS collected_at, s.current_price, a.fiscal_year, a.revenue, a.net_income / a.revenue AS net_margin FROM si_company c LEFT JOIN ox_market s ON s.ticker = c.ticker LEFT JOIN (SELECT * FROM ox_acal WHERE rn = 1) a ON a.ticker = c.ticker", r="net_margin")
def qry3(u):
    o = c.overview(u.company.select("ticker"), u.snapshots, u.annual_cal, ratio_rows(u))
    return o.select("ticker", "snapshot.collected_at", "snapshot.current_price", "annual.fiscal_year", "annual.revenue", "metrics.net_margin")


@query("qry4_statements", "SELECT ticker, period_end, revenue, net_income FROM si_quarterly QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY period_end DESC) <= 6")
def qry4(u):
    return c.statements(u.quarterly, 6, "period_end").select("ticker", "period_end", "revenue", "net_income")


@query("qry5_series", "SELECT ticker, fiscal_year, capex AS value FROM si_annual WHERE capex IS NOT NULL")
def qry5(u):
    return c.series_of(u.annual, "capex")


@query("qry6_snapshot_history", "SELECT ticker, collected_at, current_price FROM si_snapshots QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY collected_at DESC) <= 5")
def qry6(u):
    return c.snapshot_history(u.snapshots, 5).select("ticker", "collected_at", "current_price")


@query("qry7_company_rows", "SELECT model, applicable, value_base FROM ox_models WHERE ticker = 'S9'", r="value_base")
def qry7(u):
    return c.company_rows(D.results(u), "S9").select("model", "applicable", "value_base")


@query("qry8_market_series", "SELECT * FROM si_series WHERE series IN ('fred:gdp', 'shiller:cape')", r="value")
def qry8(u):
    return c.market_series(u.series, ["fred:gdp", "shiller:cape"])


R["si_holders"] = "SELECT concat('S', l_suppkey) AS ticker, CASE o_orderstatus WHEN 'F' THEN 'institutional' ELSE 'fund' END AS kind, concat('C', o_custkey) AS holder, CAST(sum(l_quantity) AS DOUBLE) AS pct FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3"


@query("qry9_holders", "SELECT * FROM si_holders WHERE kind = 'fund' ORDER BY pct DESC, holder LIMIT 30")
def qry9(u):
    return c.holders_by_type(u.holders, "fund", 30)


R["si_officers"] = "SELECT concat('S', CAST(c_custkey % 100 AS VARCHAR(6))) AS ticker, c_name AS name, c_mktsegment AS title, c_acctbal AS pay FROM customer"


@query("qry9_profile", "SELECT c.ticker, count(o.name) AS officers, arg_max(o.name, o.pay) AS best_paid FROM si_company c LEFT JOIN si_officers o ON o.ticker = c.ticker GROUP BY c.ticker")
def qry9p(u):
    p = c.profile(u.company.select("ticker"), u.officers)
    return p.select("ticker", F.coalesce(F.size("officers"), F.lit(0)).cast("long").alias("officers"), F.get("officers", F.lit(0))["name"].alias("best_paid"))


@query("qry10_summaries", "SELECT c.ticker, m.current_price, r.quality_score, b.n AS n_closes, b.first_close, b.mean_close FROM si_company c LEFT JOIN ox_market m ON m.ticker = c.ticker LEFT JOIN ox_lruns r ON r.ticker = c.ticker LEFT JOIN (SELECT ticker, CAST(count(*) AS INT) AS n, arg_min(close, date) AS first_close, avg(close) AS mean_close FROM (SELECT * FROM si_bars QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) <= 63) x GROUP BY ticker) b ON b.ticker = c.ticker", r="mean_close")
def qry10(u):
    quality = u.runs.withColumnRenamed("collected_at", "fiscal_year")
    d = c.summaries(u.company, u.snapshots, u.bars, quality)
    mean = F.aggregate("closes", F.lit(0.0), lambda a, x: a + x) / F.size("closes")
    return d.select("ticker", "current_price", "quality_score", F.size("closes").alias("n_closes"), F.get("closes", F.lit(0)).alias("first_close"), mean.alias("mean_close"))


_M = ["roa", "roe", "net_margin", "roic"]
R["ox_ratio"] = f"SELECT * FROM ({_RR}) z"


@query("qry11_compare", "SELECT metric, max(value) FILTER (ticker = 'S1') AS S1, max(value) FILTER (ticker = 'S2') AS S2, max(value) FILTER (ticker = 'S3') AS S3 FROM (" + " UNION ALL ".join(f"SELECT ticker, '{m}' AS metric, {m} AS value FROM ox_ratio WHERE rn = 1" for m in _M) + ") x WHERE ticker IN ('S1', 'S2', 'S3') GROUP BY metric", r="S1 S2 S3")
def qry11(u):
    return c.compare(ratio_rows(u), ["S1", "S2", "S3"], _M)


R["ox_medians"] = " UNION ALL ".join(f"SELECT sector_class, '{m}' AS metric, median({m}) AS median, count({m}) AS n FROM ox_ratio WHERE rn = 1 GROUP BY sector_class HAVING count({m}) > 0" for m in rat.GENERIC)


@query("qry12_sector_medians", "SELECT * FROM ox_medians", r="median")
def qry12(u):
    return c.sector_medians(ratio_rows(u).drop("sector_class"), u.company, rat.GENERIC)


@query("qry13_sector_aggregates", "SELECT c.sector_class, count(*) AS n, median(quality_score) AS median_quality, " + ", ".join(f"(SELECT median FROM ox_medians m WHERE m.sector_class = c.sector_class AND metric = '{m}') AS {m}" for m in c.HEADLINE) + " FROM si_company c LEFT JOIN ox_lruns r ON r.ticker = c.ticker GROUP BY c.sector_class", r="roic roe net_margin debt_to_ebitda")
def qry13(u):
    return c.sector_aggregates(ratio_rows(u).drop("sector_class"), u.company, u.runs.withColumnRenamed("collected_at", "fiscal_year"))


@query("qry14_peers", "SELECT m.metric, x.value AS company, m.median AS sector_median, (SELECT count(*) FROM si_company WHERE sector_class = m.sector_class) AS n_peers FROM ox_medians m JOIN (" + " UNION ALL ".join(f"SELECT sector_class, '{m}' AS metric, {m} AS value FROM ox_ratio WHERE rn = 1 AND ticker = 'S4'" for m in ("roa", "roe", "net_margin")) + ") x ON x.sector_class = m.sector_class AND x.metric = m.metric", r="company sector_median")
def qry14(u):
    return c.peers("S4", ratio_rows(u).drop("sector_class"), u.company, ["roa", "roe", "net_margin"])


@query("qry15_latest_runs", "SELECT * FROM ox_lruns")
def qry15(u):
    return q.latest_runs(u.runs).select("ticker", "quality_score", "collected_at")


@query("qry15_runs", "SELECT ticker, collected_at, run_id FROM si_runs")
def qry15r(u):
    return c.runs(u.runs).select("ticker", "collected_at", "run_id")


@query("qry15_run_warnings", "SELECT ticker, run_id, unnest([o_orderpriority, o_orderstatus]) AS warning FROM (SELECT concat('S', CAST(o_custkey % 100 AS VARCHAR)) AS ticker, o_orderkey AS run_id, o_orderpriority, o_orderstatus FROM orders) x")
def qry15w(u):
    o = u.table("orders")
    return c.run_warnings(o.select(F.concat(F.lit("S"), F.col("o_custkey") % 100).alias("ticker"), F.col("o_orderkey").alias("run_id"), F.to_json(F.array("o_orderpriority", "o_orderstatus")).alias("warnings")))


@query("qry16_unmapped", "SELECT ticker, tag, \"end\", val FROM si_unmapped")
def qry16(u):
    return c.unmapped(u.unmapped).select("ticker", "tag", "end", "val")


@query("qry17_bars_stored_at", "SELECT coalesce(a.ticker, b.ticker) AS ticker, greatest(a.m, b.m) AS stored_at FROM (SELECT ticker, max(collected_at) AS m FROM si_runs GROUP BY ticker) a FULL JOIN (SELECT ticker, CAST(max(date) AS TIMESTAMP) AS m FROM si_splits GROUP BY ticker) b ON a.ticker = b.ticker")
def qry17(u):
    log = u.splits.groupBy("date").agg(F.map_from_entries(F.collect_list(F.struct("ticker", F.col("ratio")))).alias("updated")).select(F.col("date").cast("timestamp").alias("at"), "updated")
    return c.bars_stored_at(u.runs, log)


@query("qry18_company_view", "SELECT c.ticker, (SELECT count(*) FROM ox_models m WHERE m.ticker = c.ticker) AS models, (SELECT count(*) FROM ox_signs g WHERE g.ticker = c.ticker) AS signs, (SELECT string_agg(model, ',' ORDER BY model) FROM ox_models m WHERE m.ticker = c.ticker) AS model_names FROM si_company c")
def qry18(u):
    view = c.company_view(u.company.select("ticker"), {"models": (D.results(u).select("ticker", "model", "applicable", "value_base"), "model"),
                                                       "signs": (S.signs(u), "place")})
    return view.select("ticker", F.coalesce(F.size("models"), F.lit(0)).cast("long").alias("models"), F.coalesce(F.size("signs"), F.lit(0)).cast("long").alias("signs"),
                       F.array_join(F.transform("models", lambda m: m["model"]), ",").alias("model_names"))


_LINES = ["revenue", "capex", "goodwill", "total_loans"]


@query("qry19_statement_table", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT ticker, '{n}' AS line, " + ", ".join(f"max({n}) FILTER (fiscal_year = {y}) AS y{y}" for y in (2001, 2000, 1999)) + f" FROM si_annual_cal GROUP BY ticker" for n in _LINES) + ") x WHERE coalesce(y2001, y2000, y1999) IS NOT NULL")
def qry19(u):
    t = c.statement_table(u.annual_cal, _LINES, [2001, 2000, 1999])
    return t.select("ticker", "line", *[F.col(str(y)).alias(f"y{y}") for y in (2001, 2000, 1999)])


@query("qry20_last_bar", "SELECT ticker, max(date) AS last_bar FROM si_bars GROUP BY ticker")
def qry20(u):
    return c.last_bar(u.bars)


@query("qry20_last_fetch", "SELECT series AS source, max(date) AS fetched_at, arg_max(value, date) AS value FROM si_series GROUP BY series", r="value")
def qry20f(u):
    return c.last_fetch(u.series.select(F.col("series").alias("source"), F.col("date").alias("fetched_at"), "value"))


# ---- SCR

R["ox_ins_fields"] = f"SELECT t.ticker, sum(CASE code WHEN 'P' THEN shares * price ELSE -shares * price END) AS ins_net_buy_12m, count(DISTINCT owner_cik) FILTER (code = 'P') AS ins_buyers_12m, count(DISTINCT accession) FILTER (code = 'P' AND is_ceo_cfo) AS ins_ceo_cfo_buys_12m, (SELECT max(buyers) FROM ox_ahead a WHERE a.ticker = t.ticker) AS ins_cluster_buyers_12m FROM si_trades t WHERE code IN ('P', 'S') AND date >= DATE '{O.AS_OF}' - 365 GROUP BY t.ticker"


def insider_fields(u):
    return u.shared("insider_fields", lambda: s.insider_fields(u.trades, O.as_of(), cluster_days=2))


@query("scr6_insider_fields", "SELECT * FROM ox_ins_fields", r="ins_net_buy_12m")
def scr6(u):
    return insider_fields(u)


R["ox_guru_fields"] = f"SELECT k.ticker, count(DISTINCT manager) FILTER (action <> 'sold_out') AS gurus_holding, count(DISTINCT manager) FILTER (action IN ('new', 'added')) AS gurus_buying FROM ox_fc x JOIN (SELECT DISTINCT a.ticker, b.ticker AS ct FROM si_fund_cusips a JOIN si_fund_cusips b ON substr(a.cusip, 1, 6) = substr(b.cusip, 1, 6)) k ON k.ct = x.ticker WHERE put_call = '' AND (manager, period) IN (SELECT (manager, period) FROM ox_fl WHERE complete AND {O._NEXTQ} + 48 >= (SELECT max(filed) FROM ox_fs)) GROUP BY k.ticker"


@query("scr7_guru_fields", "SELECT * FROM ox_guru_fields")
def guru_fields(u):
    from finstrata.operators.funds import share_classes
    return s.guru_fields(O.changes(u), O.quarters(u), share_classes(u.fund_cusips))


_SC = ["predictability_stars", "altman_z", "beneish_m", "sloan_ratio", "piotroski_f", "roic_minus_wacc", "ncav_per_share"]


def view(u):
    def build():
        sc = S.scores(u).select("ticker", *_SC, F.col("score_debt_to_ebitda").alias("scores_debt_to_ebitda"))
        ranks = u.shared("ranks", lambda: S.rk.rank_all(S.stable(u), S.scores(u), u.company)).drop("industry_group")
        counts = S.signs(u).groupBy("ticker").agg(F.count("*").alias("warning_count"))
        sc = sc.join(ranks, "ticker", "left").join(counts, "ticker", "left")
        ranges = H.latest_ranges(u).select("ticker", "metric", "applicable", "pct_rank", "current")
        fv = H.latest_value(u).where(F.col("fair_value").isNotNull()).select("ticker", F.lit("fair_value").alias("metric"), F.lit(True).alias("applicable"), F.lit(None).cast("double").alias("pct_rank"), F.col("fair_value").alias("current"))
        return s.wide_view(u.company, ratio_rows(u).drop("sector_class", "total_equity", "total_assets"), u.snapshots, v.intrinsic_summary(D.results(u)), D.results(u), ranges.unionByName(fv), sc, S.indicators(u), insider_fields(u), guru_fields(u))
    return u.shared("screen_view", build)


_SALT = "SELECT c.ticker, c.sector_class, c.sic, r.fiscal_year, r.roe, r.net_margin, m.current_price, sm.median_bear, sm.median_base, sm.median_bull, oe.value_base AS oe_base, ly.value_base AS lynch_base, x.pe_pct_rank AS pe_pct_10y, x.fair_value AS hist_value, st.predictability_stars, w.roic - w.wacc AS roic_minus_wacc, mg.ncav_per_share, mg.debt_to_ebitda AS scores_debt_to_ebitda, i.value_base AS vi_epv, nn.value_bear AS vi_nnwc, f.ins_buyers_12m, gf.gurus_holding, gf.gurus_buying, mk.magic_formula_rank"
R["ox_view"] = f"""SELECT *, (median_base - current_price) / current_price AS val_upside_pct, (oe_base - current_price) / current_price AS oe_upside_pct, (lynch_base - current_price) / current_price AS lynch_upside_pct, current_price / hist_value AS price_to_hist_value,
 CASE WHEN ncav_per_share > 0 THEN current_price / ncav_per_share END AS price_to_ncav, (vi_epv - current_price) / current_price AS epv_upside_pct, CASE WHEN vi_nnwc > 0 THEN current_price / vi_nnwc END AS price_to_nnwc FROM ({_SALT}
 FROM si_company c JOIN (SELECT * FROM ox_ratio WHERE rn = 1) r ON r.ticker = c.ticker LEFT JOIN ox_market m ON m.ticker = c.ticker LEFT JOIN ox_summary sm ON sm.ticker = c.ticker LEFT JOIN (SELECT * FROM ox_models WHERE model = 'owner_earnings' AND applicable) oe ON oe.ticker = c.ticker
 LEFT JOIN (SELECT * FROM ox_models WHERE model = 'lynch' AND applicable) ly ON ly.ticker = c.ticker LEFT JOIN (SELECT o.ticker, v.fair_value, CASE WHEN s.n >= 36 THEN s.pct_rank END AS pe_pct_rank FROM ox_months o LEFT JOIN ox_value v ON v.ticker = o.ticker AND v.date = o.date LEFT JOIN ox_stats s ON s.ticker = o.ticker AND s.date = o.date AND s.metric = 'pe' WHERE (o.ticker, o.date) IN (SELECT (ticker, max(date)) FROM ox_months GROUP BY ticker)) x ON x.ticker = c.ticker
 LEFT JOIN ox_stars st ON st.ticker = c.ticker LEFT JOIN ox_wacc w ON w.ticker = c.ticker LEFT JOIN ox_magic mg ON mg.ticker = c.ticker LEFT JOIN (SELECT * FROM ox_indicators WHERE indicator = 'epv' AND applicable) i ON i.ticker = c.ticker LEFT JOIN (SELECT * FROM ox_indicators WHERE indicator = 'ncav' AND applicable) nn ON nn.ticker = c.ticker
 LEFT JOIN ox_ins_fields f ON f.ticker = c.ticker LEFT JOIN ox_guru_fields gf ON gf.ticker = c.ticker LEFT JOIN ({S._MAGIC}) mk ON mk.ticker = c.ticker) z"""
_VC = ["ticker", "sector_class", "roe", "current_price", "median_base", "predictability_stars", "ins_buyers_12m", "gurus_holding", "gurus_buying", "magic_formula_rank"]
_VX = ["val_upside_pct", "oe_upside_pct", "lynch_upside_pct", "pe_pct_10y", "price_to_hist_value", "price_to_ncav", "epv_upside_pct", "price_to_nnwc", "scores_debt_to_ebitda", "roic_minus_wacc"]


@query("scr1_wide_view", f"SELECT {', '.join(_VC)} FROM ox_view", r="roe median_base")
def scr1(u):
    return view(u).select(*_VC)


@query("scr5_computed_fields", f"SELECT ticker, {', '.join(_VX)} FROM ox_view", r=" ".join(_VX))
def scr5(u):
    return view(u).select("ticker", *_VX)


@query("scr2_fields", "SELECT ticker, roe AS a, val_upside_pct AS b FROM ox_view", r="a b")
def scr2(u):
    w = view(u)
    return w.select("ticker", s.field(w, "roe").alias("a"), s.field(w, "val_upside_pct").alias("b"))


_SPEC = s.Spec((s.Filter("roe", "gt", 0), s.Filter("net_margin", "between", -0.5, 0.9)), industry="10", sort="val_upside_pct", sort_dir="desc", limit=15, offset=3)


@query("scr3_predicates", "SELECT ticker FROM ox_view WHERE roe > 0 AND net_margin BETWEEN -0.5 AND 0.9 AND starts_with(sic, '10') AND current_price < median_bear")
def scr3(u):
    w = view(u)
    return w.where(s.predicates(w, s.Spec(_SPEC.filters, industry="10", verdict="cheap"))).select("ticker")


@query("scr4_screen", "SELECT ticker, val_upside_pct FROM ox_view WHERE roe > 0 AND net_margin BETWEEN -0.5 AND 0.9 AND starts_with(sic, '10') ORDER BY val_upside_pct DESC NULLS LAST, ticker LIMIT 15 OFFSET 3", r="val_upside_pct")
def scr4(u):
    return s.screen(view(u), _SPEC).select("ticker", "val_upside_pct")


@query("scr4_count", "SELECT count(*) AS n FROM ox_view WHERE roe > 0 AND net_margin BETWEEN -0.5 AND 0.9 AND starts_with(sic, '10')")
def scr4c(u):
    return s.screen_count(view(u), _SPEC)


_PRESET_SQL = {"buffett_munger": "predictability_stars >= 4 AND roic_minus_wacc > 0 AND scores_debt_to_ebitda <= 3 AND price_to_hist_value <= 1.1", "lynch": "lynch_upside_pct > 0", "graham_net_net": "price_to_ncav <= 0.67",
               "magic_formula": "magic_formula_rank >= 1", "undervalued_predictable": "predictability_stars >= 4 AND price_to_hist_value < 0.9"}


@query("scr8_presets", " UNION ALL ".join(f"SELECT '{k}' AS preset, ticker FROM ox_view WHERE {w}" for k, w in _PRESET_SQL.items()))
def scr8(u):
    w = view(u)
    out = None
    for name, spec in s.PRESETS.items():
        part = w.where(s.predicates(w, spec)).select(F.lit(name).alias("preset"), "ticker")
        out = part if out is None else out.unionByName(part)
    return out


@query("scr9_annotate_verdicts", "SELECT ticker, CASE WHEN median_bull IS NULL THEN NULL WHEN median_bear IS NULL THEN CASE WHEN current_price > median_bull THEN 'expensive' END WHEN current_price < median_bear THEN 'cheap' WHEN current_price > median_bull THEN 'expensive' ELSE 'fair' END AS verdict, CASE WHEN oe_base IS NULL THEN NULL WHEN current_price < 0.7 * oe_base THEN 'cheap' WHEN current_price > oe_base THEN 'expensive' ELSE 'fair' END AS owner_verdict FROM ox_view")
def scr9(u):
    return s.annotate_verdicts(view(u)).select("ticker", "verdict", "owner_verdict")
