"""FCT, RES and PIT over raw facts: a supplier's orders of one month are a filing, a line is a fact of its shipping year."""

from pyspark.sql import functions as F

from finstrata import registry as reg
from finstrata.operators import facts as fx
from finstrata.operators import ratios as rat
from finstrata.operators import resolve as rs
from finstrata.operators import snapshots as sn
from finstrata.operators import splits as sp
from finstrata.plans import standin
from finstrata.plans.catalog._core import query

R = standin.RELATIONS


def _facts(tags, instant, unit="'USD'", val="CAST(floor(l_extendedprice / 15000) AS DOUBLE) * 1000 + 1000"):
    case = "CASE l_linenumber " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(tags, 1)) + f" ELSE '{tags[-1]}' END"
    start = "CAST(NULL AS DATE)" if instant else "CAST(date_trunc('year', l_shipdate) AS DATE)"
    return f"""SELECT ticker, tag, unit, start, "end", max(val) AS val, accn, form, filed FROM (
SELECT concat('S', l_suppkey) AS ticker, {case} AS tag, {unit} AS unit, {start} AS start,
  CAST(date_trunc('year', l_shipdate) + INTERVAL 1 YEAR - INTERVAL 1 DAY AS DATE) AS "end", {val} AS val,
  concat('S', l_suppkey, '-', CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR(10))) AS accn,
  CASE month(o_orderdate) % 3 WHEN 0 THEN '10-K' WHEN 1 THEN '10-Q' ELSE '10-K/A' END AS form,
  CAST(CAST(date_trunc('month', o_orderdate) AS DATE) + INTERVAL 15 MONTH AS DATE) AS filed
FROM lineitem JOIN orders ON l_orderkey = o_orderkey) f GROUP BY ticker, tag, unit, start, "end", accn, form, filed"""


R["si_f_units"] = _facts(["Assets", "Revenues", "Goodwill", "Liabilities", "Cash", "InventoryNet", "Deposits"], True, "CASE WHEN l_linenumber > 4 THEN 'EUR' WHEN l_linenumber = 4 THEN 'USD/shares' ELSE 'USD' END")
R["si_f_cash"] = _facts([fx.RESTRICTED_CASH, fx.CASH_EQUIVALENTS, "RestrictedCashCurrent", "DepositsAssetsCurrent", fx.CASH, fx.CASH_LINES[0], fx.BALANCE_TOTAL], True)
R["si_f_debt"] = _facts(["LongTermDebtNoncurrent", "LongTermDebt", "LongTermNotesPayable", "UnsecuredLongTermDebt", "NotesPayable", fx.BALANCE_TOTAL, "Assets"], True)
R["si_f_flows"] = _facts(["PaymentsToAcquirePropertyPlantAndEquipment", "PaymentsOfDividends", "RepaymentsOfLongTermDebt", "PaymentsToAcquireBusinessesNetOfCashAcquired", "PaymentsForRepurchaseOfCommonStock", "NetIncomeLoss", "Revenues"], False, val="CAST(floor(l_extendedprice / 15000) AS DOUBLE) * CASE WHEN l_returnflag = 'R' THEN 1 ELSE -1 END")
R["si_f_bank"] = _facts(["Revenues", "SalesRevenueNet", "InterestIncomeExpenseNet", "NoninterestIncome", "InterestIncomeExpenseAfterProvisionForLoanLoss", "NetIncomeLoss", "Revenues"], False)
R["si_f_eps"] = _facts([fx.TO_COMMON, "ProfitLoss", "EarningsPerShareBasic", "WeightedAverageNumberOfSharesOutstandingBasic", "EarningsPerShareDiluted", "WeightedAverageNumberOfDilutedSharesOutstanding", "NetIncomeLossAttributableToParent"], False,
                       "CASE l_linenumber WHEN 3 THEN 'USD/shares' WHEN 5 THEN 'USD/shares' WHEN 4 THEN 'shares' WHEN 6 THEN 'shares' ELSE 'USD' END", "CASE WHEN l_linenumber IN (3, 5) THEN 2.0 WHEN l_linenumber IN (4, 6) THEN CAST(floor(l_extendedprice / 30000) AS DOUBLE) + 1 ELSE (CAST(floor(l_extendedprice / 30000) AS DOUBLE) + 1) * 2000 END")
R["si_f_revenue"] = _facts(["Revenues", "SalesRevenueNet", "RevenueFromContractWithCustomerExcludingAssessedTax", "CostOfRevenue", "GrossProfit", "OperatingIncomeLoss", "OperatingExpenses"], False, val="CAST(floor(l_extendedprice / 12000) AS DOUBLE) * 1000 - 1000")
R["si_f_main"] = _facts(["Revenues", "SalesRevenueNet", "NetIncomeLoss", "PaymentsToAcquireProductiveAssets", "PaymentsToAcquirePropertyPlantAndEquipment", "ProfitLoss", "OtherTag"], False, val="CAST(floor(l_extendedprice) AS DOUBLE) * CASE WHEN l_linenumber IN (4, 5) THEN -1 ELSE 1 END")
R["si_f_balance"] = _facts(["Assets", "StockholdersEquity", "Liabilities", "Goodwill", "Deposits", "LongTermDebt", "LongTermDebtNoncurrent"], True)
R["si_f_known"] = "SELECT * FROM si_f_main UNION ALL SELECT * FROM si_f_balance"
R["si_tags"] = "SELECT p_name AS tag FROM part GROUP BY p_name"

_KEYS = ["ticker", "tag", "start", "end", "val", "accn", "filed"]
_SEL = 'ticker, tag, start, "end", val, accn, filed'


def _rule(name, rel, op, where):
    @query(name, f"SELECT {_SEL} FROM si_{rel} f WHERE {where}")
    def build(u):
        return op(getattr(u, rel)).select(*_KEYS)


_CUR = "SELECT ticker, accn, count(*) FILTER (unit = 'USD') AS usd, count(*) FILTER (unit = 'EUR') AS eur FROM si_f_units GROUP BY ALL"
_rule("fct1_drop_foreign_filings", "f_units", fx.drop_foreign_filings, f"NOT EXISTS (SELECT 1 FROM ({_CUR}) c WHERE c.ticker = f.ticker AND c.accn = f.accn AND eur > 0 AND usd <= eur)")


@query("fct2_reporting_currency", "SELECT ticker, CASE WHEN count(*) FILTER (unit = 'USD') >= count(*) FILTER (unit = 'EUR') THEN 'USD' ELSE 'EUR' END AS currency FROM si_f_units GROUP BY ticker")
def fct2(u):
    return fx.reporting_currency(u.f_units)


def _same(rel, cond, alias="o", dated=True):
    d = f' AND {alias}."end" = f."end"' if dated else ""
    return f"EXISTS (SELECT 1 FROM si_{rel} {alias} WHERE {alias}.ticker = f.ticker AND {alias}.accn = f.accn{d} AND {cond})"


_rule("fct3_balance_sheet_dates_only", "f_cash", fx.balance_sheet_dates_only, f"tag NOT IN ('{fx.RESTRICTED_CASH}', 'CommercialPaper') OR {_same('f_cash', f'''o.tag = '{fx.BALANCE_TOTAL}' ''')}")
_BT = f"o.tag IN ('{fx.BALANCE_TOTAL}', 'Assets')"
_rule("fct4_debt_on_balance_sheet_dates", "f_debt", fx.debt_on_balance_sheet_dates, f"tag IN ('{fx.BALANCE_TOTAL}', 'Assets') OR NOT {_same('f_debt', _BT, dated=False)} OR {_same('f_debt', _BT)}")


def _agr(a, b):
    return f"abs(({a}) - ({b})) <= 0.005 * greatest(abs({a}), abs({b}))"


R["ox_cashw"] = f"SELECT ticker, accn, \"end\", max(filed) AS filed, max(val) FILTER (tag = '{fx.RESTRICTED_CASH}') AS t, max(val) FILTER (tag = '{fx.CASH_EQUIVALENTS}') AS e, max(val) FILTER (tag = 'Cash') AS c, max(val) FILTER (tag = 'RestrictedCashCurrent') AS r, max(val) FILTER (tag = 'DepositsAssetsCurrent') AS d, max(val) FILTER (tag = '{fx.CASH_LINES[0]}') AS l FROM si_f_cash GROUP BY ALL"
_rule("fct5_cash_totals_set_aside", "f_cash", fx.cash_totals_set_aside, f"tag <> '{fx.RESTRICTED_CASH}' OR NOT EXISTS (SELECT 1 FROM ox_cashw w WHERE w.ticker = f.ticker AND w.accn = f.accn AND w.\"end\" = f.\"end\" AND ({_agr('r', 't - e')} OR {_agr('d', 't - e')} OR {_agr('r + d', 't - e')}))")
_SHOWN = "SELECT ticker, \"end\", filed AS day, unnest([l, CASE WHEN e <> 0 THEN c + e END]) AS line, c FROM ox_cashw WHERE c IS NOT NULL"
_rule("fct6_cash_parts_set_aside", "f_cash", fx.cash_parts_set_aside, f"tag <> 'Cash' OR NOT EXISTS (SELECT 1 FROM ox_cashw t JOIN ({_SHOWN}) s ON s.ticker = t.ticker AND s.\"end\" = t.\"end\" AND s.day <= t.filed WHERE t.ticker = f.ticker AND t.accn = f.accn AND line > s.c AND NOT ({_agr('line', 's.c')}) AND {_agr('line', 't.t')})")


@query("fct7_net_outflows_as_paid", f"SELECT ticker, tag, start, \"end\", CASE WHEN tag = 'PaymentsToAcquireBusinessesNetOfCashAcquired' AND (SELECT sum(-sign(val)) FROM si_f_flows o WHERE o.ticker = f.ticker AND o.accn = f.accn AND o.tag IN ('PaymentsToAcquirePropertyPlantAndEquipment', 'PaymentsOfDividends', 'RepaymentsOfLongTermDebt', 'PaymentsForRepurchaseOfCommonStock')) > 0 THEN -val ELSE val END AS val, accn, filed FROM si_f_flows f", r="val")
def fct7(u):
    return fx.net_outflows_as_paid(u.f_flows).select(*_KEYS)


def _part(tag, later):
    return " OR ".join(f"(p.tag = '{tag}' AND EXISTS (SELECT 1 FROM si_f_debt q WHERE q.ticker = p.ticker AND q.accn = p.accn AND q.\"end\" = p.\"end\" AND q.tag = '{l}' AND q.val * 0.5 > p.val))" for l in later)


_PARTS = " OR ".join([_part("LongTermDebtNoncurrent", ["LongTermNotesPayable", "UnsecuredLongTermDebt"]), _part("LongTermNotesPayable", ["UnsecuredLongTermDebt"]), _part("LongTermDebt", ["NotesPayable"])])
_rule("fct8_debt_parts_set_aside", "f_debt", fx.debt_parts_set_aside, f"NOT EXISTS (SELECT 1 FROM si_f_debt p WHERE p.ticker = f.ticker AND p.tag = f.tag AND p.\"end\" = f.\"end\" AND p.val = f.val AND p.filed <= f.filed AND ({_PARTS}))")


def _per(rel, alias, tag):
    return f"(SELECT max(val) FROM si_{rel} x WHERE x.ticker = {alias}.ticker AND x.accn = {alias}.accn AND x.\"end\" = {alias}.\"end\" AND x.tag = '{tag}')"


@query("fct14_bank_revenue_parts", f"SELECT ticker, accn, start, \"end\", tag FROM si_f_bank f WHERE tag IN ('Revenues', 'SalesRevenueNet') AND val < 0.8 * (coalesce({_per('f_bank', 'f', 'InterestIncomeExpenseNet')}, {_per('f_bank', 'f', 'InterestIncomeExpenseAfterProvisionForLoanLoss')}) + {_per('f_bank', 'f', 'NoninterestIncome')})")
def fct14(u):
    return fx.bank_revenue_parts(u.f_bank)


def _gap(v):
    return f"least({', '.join(f'abs(n * {s} / ({v} / eps) - 1)' for s in ('1e-6', '1e-3', '1.0', '1e3', '1e6'))})"


R["ox_epsw"] = "SELECT *, CASE WHEN eb IS NOT NULL AND nb IS NOT NULL THEN eb ELSE CASE WHEN nd IS NOT NULL THEN ed END END AS eps, CASE WHEN eb IS NOT NULL AND nb IS NOT NULL THEN nb ELSE CASE WHEN ed IS NOT NULL THEN nd END END AS n FROM (SELECT ticker, accn, start, \"end\", " + ", ".join(f"max(val) FILTER (tag = '{t}') AS {n}" for t, n in ((fx.TO_COMMON, "v"), ("ProfitLoss", "o2"), ("NetIncomeLossAttributableToParent", "o1"), ("EarningsPerShareBasic", "eb"), ("WeightedAverageNumberOfSharesOutstandingBasic", "nb"), ("EarningsPerShareDiluted", "ed"), ("WeightedAverageNumberOfDilutedSharesOutstanding", "nd"))) + " FROM si_f_eps GROUP BY ALL) x"


@query("fct15_to_common_contradicted", f"SELECT ticker, accn, start, \"end\" FROM ox_epsw WHERE v IS NOT NULL AND abs(eps) >= 0.1 AND {_gap('v')} > 0.1")
def fct15(u):
    return fx.to_common_contradicted(u.f_eps)


@query("fct16_to_common_set_aside", f"SELECT ticker, accn, start, \"end\" FROM ox_epsw WHERE v IS NOT NULL AND eps IS NOT NULL AND {_gap('v')} > 0.1 AND ({_gap('o1')} <= 0.1 OR {_gap('o2')} <= 0.1)")
def fct16(u):
    return fx.to_common_set_aside(u.f_eps)


R["ox_revw"] = "SELECT ticker, year(\"end\") AS fiscal_year, tag, arg_max(val, CAST(filed AS VARCHAR) || accn) AS val FROM si_f_revenue WHERE form IN ('10-K', '10-K/A') GROUP BY ALL"
R["ox_revt"] = "SELECT ticker, fiscal_year, max(val) FILTER (tag = 'CostOfRevenue') AS c, max(val) FILTER (tag = 'CostOfRevenue') + max(val) FILTER (tag = 'GrossProfit') AS t1, max(val) FILTER (tag = 'OperatingIncomeLoss') + max(val) FILTER (tag = 'OperatingExpenses') AS t2 FROM ox_revw GROUP BY ALL"
R["ox_revf"] = f"SELECT r.*, c, coalesce({_agr('val', 't1')}, false) OR coalesce({_agr('val', 't2')}, false) AS adds FROM ox_revw r JOIN ox_revt t USING (ticker, fiscal_year) WHERE tag IN ('Revenues', 'SalesRevenueNet', 'RevenueFromContractWithCustomerExcludingAssessedTax')"


@query("fct17_revenue_set_aside", """SELECT DISTINCT a.ticker, CAST(a.fiscal_year AS INT) AS fiscal_year, a.tag FROM ox_revf a JOIN ox_revf b ON a.ticker = b.ticker AND a.fiscal_year = b.fiscal_year
JOIN (SELECT ticker, fiscal_year, bool_or(adds) AS supported FROM ox_revf GROUP BY ALL) s ON s.ticker = a.ticker AND s.fiscal_year = a.fiscal_year
WHERE ((a.val <= 0 AND b.val > 0) OR (a.val > 0 AND a.val * 1.25 <= b.val) OR (b.val > 0 AND b.val * 1.25 <= a.val))
 AND CASE WHEN supported THEN b.adds AND NOT a.adds ELSE (a.val <= 0 AND b.val > 0) OR coalesce(a.val < a.c AND a.c <= b.val, false) END""")
def fct17(u):
    return fx.revenue_set_aside(u.f_revenue)


@query("fct18_merge_predecessor", f"SELECT {_SEL} FROM si_f_debt WHERE filed >= DATE '1998-06-01' UNION ALL SELECT {_SEL} FROM si_f_debt f WHERE filed < (SELECT min(filed) FROM si_f_debt s WHERE s.ticker = f.ticker AND s.filed >= DATE '1998-06-01' AND s.form IN ('10-K', '10-K/A', '10-Q'))")
def fct18(u):
    new = u.f_debt.where(F.col("filed") >= F.lit("1998-06-01").cast("date"))
    old = u.f_debt.withColumn("ticker", F.regexp_replace("ticker", "S", "P"))
    m = u.company.select("ticker", F.regexp_replace("ticker", "S", "P").alias("predecessor"))
    return fx.merge_predecessor(new, old, m).select(*_KEYS)


R["si_listed"] = "SELECT ticker, accn, form, filed FROM si_f_main GROUP BY ticker, accn, form, filed"


@query("fct19_report_gap", "SELECT ticker, accn, form, filed FROM (SELECT l.*, max((l.filed < DATE '2001-01-01' + CAST(substr(l.ticker, 2) AS INT))::INT) OVER (PARTITION BY ticker ORDER BY filed DESC, accn DESC) AS seen, row_number() OVER (PARTITION BY ticker ORDER BY filed DESC, accn DESC) AS k FROM si_listed l WHERE form IN ('10-K', '10-Q')) x WHERE k <= 12 AND seen = 0")
def fct19(u):
    have = u.f_main.where(F.col("filed") < F.date_add(F.lit("2001-01-01").cast("date"), F.substring("ticker", 2, 9).cast("int")))
    return fx.report_gap(u.listed, have, 12)


@query("fct20_merge_report_facts", f"SELECT {_SEL} FROM si_f_main WHERE form = '10-K' UNION ALL SELECT {_SEL} FROM si_f_balance f WHERE NOT EXISTS (SELECT 1 FROM si_f_main m WHERE m.ticker = f.ticker AND m.accn = f.accn AND m.form = '10-K')")
def fct20(u):
    return fx.merge_report_facts(u.f_main.where(F.col("form") == "10-K"), u.f_balance).select(*_KEYS)


@query("fct21_unmapped_facts", "SELECT ticker, tag, max(\"end\") AS period_end, arg_max(val, CAST(\"end\" AS VARCHAR) || CAST(filed AS VARCHAR) || accn || lpad(CAST(CAST(val AS BIGINT) AS VARCHAR), 12, '0')) AS value FROM si_f_main WHERE tag = 'OtherTag' AND abs(val) >= 30000 AND year(\"end\") >= 1997 GROUP BY ALL")
def fct21(u):
    return fx.unmapped_facts(u.f_main, reg.registry(u.spark), 30000.0, 1997)


@query("fct22_explain_record", "SELECT ticker, reason FROM (SELECT f.ticker, CASE WHEN last IS NULL THEN CASE WHEN eur > usd THEN 'reports in EUR' ELSE 'no full-year figure in an annual report' END WHEN last < DATE '2001-06-01' THEN 'its latest year ended ' || CAST(last AS VARCHAR) END AS reason FROM (SELECT ticker, count(*) FILTER (unit = 'USD') AS usd, count(*) FILTER (unit = 'EUR') AS eur FROM si_f_units GROUP BY ticker) f LEFT JOIN (SELECT ticker, max(CASE WHEN CAST(substring(ticker, 2) AS INT) % 3 > 0 AND (fiscal_year < 2001 OR CAST(substring(ticker, 2) AS INT) % 3 = 1) THEN period_end END) AS last FROM si_annual_cal GROUP BY ticker) a ON a.ticker = f.ticker) x WHERE reason IS NOT NULL")
def fct22(u):
    k = F.substring("ticker", 2, 9).cast("int") % 3
    a = u.annual_cal.withColumn("period_end", F.when((k > 0) & ((F.col("fiscal_year") < 2001) | (k == 1)), F.col("period_end")))
    return fx.explain_record(u.f_units, a, F.lit("2001-06-01").cast("date"))


@query("fct23_known_by", f"SELECT {_SEL} FROM si_f_main WHERE filed <= DATE '1999-05-01'")
def fct23(u):
    return fx.known_by(u.f_main, F.lit("1999-05-01").cast("date")).select(*_KEYS)


@query("fct23_filing_dates", "SELECT DISTINCT ticker, filed FROM si_f_main WHERE filed <= DATE '2001-01-01'")
def fct23d(u):
    return fx.filing_dates(u.f_main.withColumn("filed", F.when(F.col("filed") <= F.lit("2001-01-01").cast("date"), F.col("filed"))))


@query("fct23_undated", "SELECT ticker, count(*) FILTER (filed > DATE '2001-01-01') AS undated FROM si_f_main GROUP BY ticker")
def fct23u(u):
    return fx.undated(u.f_main.withColumn("filed", F.when(F.col("filed") <= F.lit("2001-01-01").cast("date"), F.col("filed"))))


# ---- RES

_PRIO = {"Revenues": ("revenue", 0, 6), "SalesRevenueNet": ("revenue", 4, 6), "NetIncomeLoss": ("net_income", 0, 4), "ProfitLoss": ("net_income", 3, 4), "PaymentsToAcquirePropertyPlantAndEquipment": ("capex", 0, 2), "PaymentsToAcquireProductiveAssets": ("capex", 1, 2)}
_BPRIO = {"Assets": ("total_assets", 0), "StockholdersEquity": ("total_equity", 0), "Liabilities": ("total_liabilities", 0), "Goodwill": ("goodwill", 0), "Deposits": ("total_deposits", 0), "LongTermDebt": ("long_term_debt", 1), "LongTermDebtNoncurrent": ("long_term_debt", 0)}


def _case(col, table, i):
    return f"CASE {col} " + " ".join(f"WHEN '{t}' THEN {v[i]!r}" for t, v in table.items()) + " END"


R["ox_cand"] = f"SELECT *, {_case('tag', _PRIO, 0)} AS field, {_case('tag', _PRIO, 1)} AS priority, {_case('tag', _PRIO, 2)} AS n_tags, CAST(year(\"end\") AS INT) AS fiscal_year, CASE WHEN tag LIKE 'PaymentsToAcquireP%' THEN abs(val) ELSE val END AS v FROM si_f_main WHERE tag <> 'OtherTag'"
_ORD = "lpad(CAST(99 - priority AS VARCHAR), 2, '0') || CAST(filed AS VARCHAR) || accn || lpad(CAST(CAST(val + 500000 AS BIGINT) AS VARCHAR), 12, '0')"


def _winner(keys, where="true", order=_ORD):
    return f"SELECT {keys}, field, arg_max(v, {order}) AS val, arg_max(tag, {order}) AS tag, arg_max(accn, {order}) AS accn FROM ox_cand WHERE {where} GROUP BY {keys}, field"


_RESOLVED = ["field", "val", "tag", "accn"]


def registry(u):
    return reg.registry(u.spark)


@query("res3_year_ends", "SELECT ticker, fiscal_year, \"end\" AS year_end FROM (SELECT ticker, CAST(year(\"end\") AS INT) AS fiscal_year, \"end\", row_number() OVER (PARTITION BY ticker, year(\"end\") ORDER BY count(DISTINCT field) DESC, \"end\" DESC) AS k FROM (SELECT ticker, field, \"end\" - CASE WHEN accn LIKE '%-02-%' OR accn LIKE '%-03-%' THEN 30 ELSE 0 END AS \"end\" FROM ox_cand WHERE form IN ('10-K', '10-K/A')) c GROUP BY ticker, \"end\") x WHERE k = 1")
def res3(u):
    early = F.col("accn").contains("-02-") | F.col("accn").contains("-03-")
    f = u.f_main.withColumns({"end": F.when(early, F.date_sub("end", 30)).otherwise(F.col("end")), "start": F.when(early, F.date_sub("start", 30)).otherwise(F.col("start"))})
    return rs.year_ends(f, registry(u))


@query("res3_year_ends_by_filing", """WITH c AS (SELECT ticker, field, filed, year("end") AS fiscal_year, "end" - CASE WHEN accn LIKE '%-02-%' OR accn LIKE '%-03-%' THEN 30 ELSE 0 END AS "end" FROM ox_cand WHERE form IN ('10-K', '10-K/A'))
SELECT ticker, CAST(fiscal_year AS INT) AS fiscal_year, filed, "end" AS year_end FROM (SELECT d.ticker, d.fiscal_year, d.filed, c."end", row_number() OVER (PARTITION BY d.ticker, d.fiscal_year, d.filed ORDER BY count(DISTINCT field) DESC, c."end" DESC) AS k FROM (SELECT DISTINCT ticker, fiscal_year, filed FROM c) d JOIN c ON c.ticker = d.ticker AND c.fiscal_year = d.fiscal_year AND c.filed <= d.filed GROUP BY d.ticker, d.fiscal_year, d.filed, c."end") x WHERE k = 1""")
def res3f(u):
    early = F.col("accn").contains("-02-") | F.col("accn").contains("-03-")
    f = u.f_main.withColumns({"end": F.when(early, F.date_sub("end", 30)).otherwise(F.col("end")), "start": F.when(early, F.date_sub("start", 30)).otherwise(F.col("start"))})
    return rs.year_ends_by_filing(f, registry(u))


@query("res4_resolve_canonical", _winner("ticker, \"end\"", order=_ORD.replace("99 - priority", "99 - priority - CASE WHEN tag = 'Revenues' AND year(\"end\") = 1998 THEN n_tags ELSE 0 END")))
def res4(u):
    c = rs.candidates(u.f_main, registry(u)).withColumns({"fiscal_year": F.year("end"), "pe": F.col("end")})
    aside = u.company.select("ticker").withColumns({"tag": F.lit("Revenues"), "field": F.lit("revenue"), "fiscal_year": F.lit(1998)})
    return rs.resolve_canonical(c, ["ticker", "pe"], aside).drop("end").select("ticker", F.col("pe").alias("end"), *_RESOLVED)


@query("res5_annual_record", f"SELECT * FROM ({_winner('ticker, fiscal_year', '''form IN ('10-K', '10-K/A')''')}) x WHERE fiscal_year > (SELECT max(fiscal_year) FROM ox_cand c WHERE c.ticker = x.ticker AND form IN ('10-K', '10-K/A')) - 4")
def res5(u):
    return rs.annual_record(u.f_main, registry(u), 4).select("ticker", "fiscal_year", *_RESOLVED)


@query("res6_vintages", _winner("ticker, fiscal_year, accn", "form IN ('10-K', '10-K/A')").replace(", arg_max(accn, " + _ORD + ") AS accn", ""))
def res6(u):
    v = rs.vintages(u.f_main, registry(u))
    return v.select("ticker", "fiscal_year", F.col("filing").alias("accn"), "field", "val", "tag")


@query("res5_wide_record", "SELECT ticker, fiscal_year, max(val) FILTER (field = 'revenue') AS revenue, max(val) FILTER (field = 'net_income') AS net_income, max(val) FILTER (field = 'capex') AS capex, max(tag) FILTER (field = 'revenue') AS revenue_tag FROM (" + _winner("ticker, fiscal_year", "form IN ('10-K', '10-K/A')") + ") x GROUP BY ALL")
def res5w(u):
    w = rs.to_wide(rs.annual_record(u.f_main, registry(u)), ["ticker", "fiscal_year"], ["revenue", "net_income", "capex"])
    return w.select("ticker", "fiscal_year", "revenue", "net_income", "capex", F.col("source_tags")["revenue"].alias("revenue_tag"))


@query("res8_instant_checkpoints", f"SELECT ticker, \"end\" AS period_end, {_case('tag', _BPRIO, 0)} AS field, arg_max(val, lpad(CAST(9 - {_case('tag', _BPRIO, 1)} AS VARCHAR), 2, '0') || CAST(filed AS VARCHAR) || accn) AS val FROM si_f_balance GROUP BY ticker, \"end\", {_case('tag', _BPRIO, 0)}")
def res8(u):
    return rs.instant_checkpoints(u.f_balance, registry(u)).select("ticker", "period_end", "field", "val")


# Year-to-date rungs: running sums of a quarter's flows and a running mean of its share count.
R["si_ladder"] = """
SELECT ticker, field, CAST(date_trunc('year', period_end) AS DATE) AS start, period_end AS "end", CASE WHEN NOT (fiscal_quarter = 2 AND val > 3000000) THEN val END AS val, CASE WHEN fiscal_quarter = 4 THEN '10-K' ELSE '10-Q' END AS form FROM (
SELECT ticker, period_end, fiscal_year, fiscal_quarter, 'revenue' AS field, sum(revenue) OVER w AS val FROM si_quarterly WINDOW w AS (PARTITION BY ticker, fiscal_year ORDER BY period_end)
UNION ALL SELECT ticker, period_end, fiscal_year, fiscal_quarter, 'capex', sum(CASE WHEN capex IS NULL THEN 0 ELSE capex END) OVER (PARTITION BY ticker, fiscal_year ORDER BY period_end) - CASE WHEN fiscal_quarter = 3 THEN 200000 ELSE 0 END FROM si_quarterly
UNION ALL SELECT ticker, period_end, fiscal_year, fiscal_quarter, 'acquisitions', sum(paid) OVER w FROM (SELECT *, CASE WHEN fiscal_quarter = 3 THEN -net_income * 2 ELSE net_income END AS paid FROM si_quarterly) q WINDOW w AS (PARTITION BY ticker, fiscal_year ORDER BY period_end)
UNION ALL SELECT ticker, period_end, fiscal_year, fiscal_quarter, 'weighted_avg_shares_diluted', weighted_avg_shares_diluted + fiscal_quarter * 10 FROM si_quarterly) l
"""
R["ox_lad"] = "SELECT *, lag(val) OVER w AS pv, lag(\"end\") OVER w AS pe, count(*) OVER (PARTITION BY ticker, field, start) AS n FROM (SELECT * FROM si_ladder WHERE val IS NOT NULL) l WINDOW w AS (PARTITION BY ticker, field, start ORDER BY \"end\")"
R["ox_quarters"] = """SELECT * FROM (SELECT ticker, field, start, "end" AS period_end, CASE WHEN date_diff('day', start, "end") BETWEEN 80 AND 120 THEN CASE WHEN field = 'capex' THEN abs(val) ELSE val END WHEN date_diff('day', pe, "end") BETWEEN 80 AND 120 THEN
 CASE field WHEN 'capex' THEN CASE WHEN abs(val) >= abs(pv) THEN abs(val) - abs(pv) END WHEN 'acquisitions' THEN CASE WHEN NOT (pv > 0 AND val <= pv / 2) THEN val - pv END
 WHEN 'weighted_avg_shares_diluted' THEN (val * (date_diff('day', start, "end") + 1) - pv * (date_diff('day', start, pe) + 1)) / date_diff('day', pe, "end") ELSE val - pv END END AS value, date_diff('day', start, "end") BETWEEN 80 AND 120 AND n = 1 AS lone FROM ox_lad) x WHERE value IS NOT NULL AND NOT (field = 'weighted_avg_shares_diluted' AND value <= 0)"""


def quarters(u):
    return rs.discrete_quarters(u.ladder, registry(u))


def _field_query(name, field):
    @query(name, f"SELECT ticker, period_end, value FROM ox_quarters WHERE field = '{field}'", r="value")
    def build(u):
        return quarters(u).where(F.col("field") == field).select("ticker", "period_end", "value")


_field_query("res9_discrete_quarters", "revenue")
_field_query("res10_outflow_quarters", "capex")
_field_query("res10_net_outflow_quarters", "acquisitions")
_field_query("res11_weighted_share_quarters", "weighted_avg_shares_diluted")


@query("res12_lone_first_quarter", "SELECT q.ticker, q.field, q.period_end, q.value FROM (SELECT *, date_diff('day', start, period_end) < 120 AND month(start) = 1 AND year(start) % 2 = 0 AS single FROM ox_quarters) q WHERE NOT single OR EXISTS (SELECT 1 FROM si_splits s WHERE s.ticker = q.ticker AND year(s.date) = year(q.period_end))", r="value")
def res12(u):
    q = quarters(u).withColumn("lone", (F.datediff("period_end", "start") < 120) & (F.year("start") % 2 == 0))
    years = u.splits.select("ticker", F.year("date").alias("y")).distinct()
    have = q.select("ticker", "period_end").distinct().withColumn("y", F.year("period_end")).join(years, ["ticker", "y"]).drop("y")
    return rs.quarters_of(q, have).drop("start")


@query("res13_ladder_year", "SELECT ticker, start, CAST(CASE WHEN closed THEN year(start) WHEN prev IS NOT NULL THEN prev + 1 + (year(start) - prev - 1) ELSE year(start) END AS INT) AS fiscal_year, closed FROM (SELECT *, max(CASE WHEN closed THEN year(start) END) OVER (PARTITION BY ticker ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM (SELECT ticker, start, bool_or(form = '10-K') AS closed FROM (SELECT * FROM si_ladder WHERE NOT (form = '10-K' AND val > 4000000)) l WHERE field = 'revenue' GROUP BY ALL) x) y")
def res13(u):
    return rs.ladder_year(u.ladder.where((F.col("field") == "revenue") & ~((F.col("form") == "10-K") & (F.col("val") > 4000000))))


R["si_f_counts"] = _facts(["CommonStockSharesOutstanding"] * 7, True, "'shares'", "CAST(1000 AS DOUBLE) * CASE WHEN o_orderdate > TIMESTAMP '1998-06-01 00:00:00' THEN 2 ELSE 1 END * CASE WHEN o_orderdate > TIMESTAMP '2000-03-01 00:00:00' THEN 3 ELSE 1 END * (1 + l_suppkey % 7)")


@query("res14_split_restatements", """SELECT ticker, ratio, max(after) AS after, min(through) AS through, count(*) AS windows FROM (
 SELECT *, sum((coalesce(after >= top, true))::INT) OVER (PARTITION BY ticker, ratio ORDER BY after, through) AS g FROM (
 SELECT *, max(through) OVER (PARTITION BY ticker, ratio ORDER BY after, through ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM (
 SELECT DISTINCT ticker, val / pv AS ratio, after, filed AS through FROM (SELECT ticker, "end", filed, max(val) AS val, lag(max(val)) OVER (PARTITION BY ticker, "end" ORDER BY filed) AS pv, lag(filed) OVER (PARTITION BY ticker, "end" ORDER BY filed) AS after FROM si_f_counts GROUP BY ticker, "end", filed) a WHERE val <> pv) b) c) d GROUP BY ticker, ratio, g HAVING count(*) >= 2""")
def res14(u):
    return rs.split_restatements(u.f_counts, ["CommonStockSharesOutstanding"], sp.is_simple_ratio)


@query("res21_validate_rows", "SELECT doc_id, TRY_CAST(lang AS DOUBLE) AS a, TRY_CAST(substr(source, 4) AS INT) AS b, CAST((lang IS NOT NULL AND TRY_CAST(lang AS DOUBLE) IS NULL)::INT + (substr(source, 4) IS NOT NULL AND TRY_CAST(substr(source, 4) AS INT) IS NULL)::INT AS INT) AS n_errors FROM documents")
def res21(u):
    d = u.table("documents").select("doc_id", F.col("lang").alias("a"), F.expr("substr(source, 4)").alias("b"))
    v = rs.validate_rows(d, {"a": "double", "b": "int"})
    return v.select("doc_id", "a", "b", F.size("validation_errors").alias("n_errors"))


@query("res28_classify_sector", "SELECT ticker, CASE WHEN code BETWEEN 6020 AND 6299 THEN CASE WHEN EXISTS (SELECT 1 FROM si_f_balance f WHERE f.ticker = x.ticker AND f.tag = 'Deposits' AND f.val >= 7000 AND f.filed > DATE '2002-06-01') THEN 'bank' ELSE 'general' END WHEN code BETWEEN 6300 AND 6411 AND code <> 6324 THEN 'insurance' WHEN code = 6798 THEN 'reit' WHEN code BETWEEN 4900 AND 4991 THEN 'utility' WHEN code BETWEEN 1300 AND 1399 THEN 'energy' ELSE 'general' END AS sector_class FROM (SELECT ticker, CASE company_no % 6 WHEN 0 THEN 6021 WHEN 1 THEN 6331 WHEN 2 THEN 6798 WHEN 3 THEN 4911 WHEN 4 THEN 1311 ELSE 6324 END AS code FROM si_company) x")
def res28(u):
    code = F.element_at(F.array(*[F.lit(str(c)) for c in (6021, 6331, 6798, 4911, 1311, 6324)]), (F.col("company_no") % 6 + 1).cast("int"))
    f = u.f_balance.where((F.col("tag") != "Deposits") | ((F.col("val") >= 7000) & (F.col("filed") > F.lit("2002-06-01").cast("date"))))
    return rs.classify_sector(u.company.withColumn("sic", code), f)


# Every second company files a year early, and reports of four months end the year two months before, so years open, leave and return.
R["si_f_snap"] = """SELECT ticker, tag, unit, CASE WHEN month(filed) IN (4, 5, 6, 7) THEN CAST(start - INTERVAL 60 DAY AS DATE) ELSE start END AS start,
  CASE WHEN month(filed) IN (4, 5, 6, 7) THEN CAST("end" - INTERVAL 60 DAY AS DATE) ELSE "end" END AS "end", val, accn, form,
  CASE WHEN CAST(substring(ticker, 2) AS INT) % 2 = 1 THEN CAST(filed - INTERVAL 12 MONTH AS DATE) ELSE filed END AS filed FROM si_f_known"""
_SNAP = {t: v[:2] for t, v in _PRIO.items()} | _BPRIO
_SNAP_FIELDS = sorted({v[0] for v in _SNAP.values()})
R["ox_snap_c"] = f"SELECT *, {_case('tag', _SNAP, 0)} AS field, {_case('tag', _SNAP, 1)} AS priority, CAST(year(\"end\") AS INT) AS fiscal_year, CASE WHEN tag LIKE 'PaymentsToAcquireP%' THEN abs(val) ELSE val END AS v FROM si_f_snap WHERE tag <> 'OtherTag' AND form IN ('10-K', '10-K/A')"
R["ox_snap_d"] = "SELECT ticker, filed AS day, max(accn) AS known_accn FROM si_f_snap GROUP BY ticker, filed"
R["ox_snap_e"] = """SELECT ticker, fiscal_year, day, known_accn, "end" AS period_end FROM (
 SELECT c.ticker, c.fiscal_year, d.day, d.known_accn, c."end", row_number() OVER (PARTITION BY c.ticker, c.fiscal_year, d.day ORDER BY count(DISTINCT field) FILTER (start IS NOT NULL) DESC, c."end" DESC) AS k
 FROM ox_snap_c c JOIN ox_snap_d d ON d.ticker = c.ticker AND c.filed <= d.day GROUP BY c.ticker, c.fiscal_year, d.day, d.known_accn, c."end") x WHERE k = 1"""
_SORD = _ORD.replace("priority", "c.priority").replace("filed", "c.filed").replace("accn", "c.accn").replace("val +", "c.val +")
R["ox_snap_w"] = f"""SELECT e.ticker, e.fiscal_year, e.day, e.known_accn, e.period_end, field, arg_max({{'v': v, 'tag': tag, 'accn': accn, 'filed': filed, 'form': form}}, {_SORD}) AS f
 FROM ox_snap_e e JOIN ox_snap_c c ON c.ticker = e.ticker AND c.fiscal_year = e.fiscal_year AND c.filed <= e.day AND abs(date_diff('day', c."end", e.period_end)) <= 7 GROUP BY e.ticker, e.fiscal_year, e.day, e.known_accn, e.period_end, field"""
R["ox_snap_s"] = f"""SELECT ticker, fiscal_year, day AS known_from, known_accn, period_end <= day AS present, period_end, {', '.join(f"max(f.v) FILTER (field = '{x}') AS {x}" for x in _SNAP_FIELDS)},
 string_agg(field || '=' || f.tag, ',' ORDER BY field) AS tags, string_agg(field || '=' || f.accn || ' ' || f.form, ',' ORDER BY field) AS filings, max({{'filed': f.filed, 'accn': f.accn, 'form': f.form}}) AS latest
 FROM ox_snap_w GROUP BY ticker, fiscal_year, day, known_accn, period_end"""
_SNAP_VALUE = {x: x for x in _SNAP_FIELDS} | {"total_liabilities": "coalesce(total_liabilities, total_assets - total_equity)"}


@query("res23_build_snapshots", f"""SELECT ticker, fiscal_year, known_from, known_accn, present, CASE WHEN present THEN period_end END AS period_end,
 {', '.join(f"CASE WHEN present THEN {_SNAP_VALUE[x]} END AS {x}" if x in _SNAP_VALUE else f"CAST(NULL AS DOUBLE) AS {x}" for x in reg.FIELDS)},
 CASE WHEN present THEN tags END AS tags, CASE WHEN present THEN filings END AS filings, CASE WHEN present THEN latest.accn END AS accn, CASE WHEN present THEN latest.filed END AS filed_date, CASE WHEN present THEN latest.form END AS form
 FROM (SELECT *, lag(present) OVER w AS was_present, lag(state) OVER w AS was FROM (
  SELECT *, CASE WHEN present THEN concat_ws('|', period_end, tags, filings, {', '.join(f"coalesce(CAST({x} AS VARCHAR), '-')" for x in _SNAP_FIELDS)}) ELSE 'gone' END AS state FROM ox_snap_s) s
  WINDOW w AS (PARTITION BY ticker, fiscal_year ORDER BY known_from)) z WHERE CASE WHEN was_present IS NULL THEN present ELSE state IS DISTINCT FROM was END""")
def res23(u):
    entries = lambda m, say: F.array_join(F.transform(F.map_entries(m), say), ",")
    return snapshots(u).select("ticker", "fiscal_year", "known_from", "known_accn", "present", "period_end", *reg.FIELDS,
                               entries("source_tags", lambda e: F.concat(e["key"], F.lit("="), e["value"])).alias("tags"),
                               entries("source_filings", lambda e: F.concat(e["key"], F.lit("="), e["value"]["accn"], F.lit(" "), e["value"]["form"])).alias("filings"), "accn", "filed_date", "form")


def snapshots(u):
    return u.shared("known_rows", lambda: sn.build_snapshots(u.f_snap, registry(u)))


@query("res24_changed_days", "SELECT DISTINCT ticker, filed AS day FROM ox_cand WHERE form IN ('10-K', '10-K/A')")
def res24(u):
    return rs.changed_days(u.f_main, registry(u))


# ---- PIT: rows known from each filing day; a day in eleven drops the year from the record.

R["si_known"] = """
SELECT ticker, CAST(year("end") AS INT) AS fiscal_year, filed AS known_from, max(accn) AS accn, CAST(sum(val) AS BIGINT) % 11 <> 0 AS present,
  sum(CASE WHEN tag = 'Revenues' THEN val END) AS revenue, sum(CASE WHEN tag = 'NetIncomeLoss' THEN val END) AS net_income, sum(CASE WHEN tag = 'SalesRevenueNet' THEN val END) AS total_assets
FROM si_f_main GROUP BY ticker, year("end"), filed
"""
R["si_probes"] = "SELECT ticker, CAST(year(period_end) - 1 AS INT) AS fiscal_year, period_end AS day FROM si_quarterly"
R["ox_pit"] = "SELECT p.ticker, p.fiscal_year, p.day, k.known_from, k.accn, k.present, k.revenue, k.net_income, k.total_assets FROM si_probes p ASOF JOIN si_known k ON p.ticker = k.ticker AND p.fiscal_year = k.fiscal_year AND p.day >= k.known_from"


@query("pit1_as_of_annual", "SELECT ticker, fiscal_year, day, known_from, accn, revenue, net_income FROM ox_pit WHERE present")
def pit1(u):
    return rs.as_of_annual(u.known, u.probes).select("ticker", "fiscal_year", "day", "known_from", "accn", "revenue", "net_income")


@query("pit2_as_of_value", "SELECT ticker, fiscal_year, day, revenue FROM ox_pit WHERE present")
def pit2(u):
    return rs.as_of_value(u.known, u.probes, "revenue")


R["ox_hist"] = "SELECT g.ticker, g.day, g.fiscal_year, k.known_from, k.present, k.revenue, k.net_income, k.total_assets FROM (SELECT p.ticker, p.day, y.fiscal_year FROM si_probes p JOIN (SELECT DISTINCT ticker, fiscal_year FROM si_known) y ON y.ticker = p.ticker) g ASOF JOIN si_known k ON g.ticker = k.ticker AND g.fiscal_year = k.fiscal_year AND g.day >= k.known_from"


@query("pit3_history_as_of", "SELECT ticker, day, fiscal_year, revenue FROM ox_hist WHERE present QUALIFY row_number() OVER (PARTITION BY ticker, day ORDER BY fiscal_year DESC) <= 3")
def pit3(u):
    return rs.history_as_of(u.known, u.probes.select("ticker", "day"), 3).select("ticker", "day", "fiscal_year", "revenue")


@query("pit4_carried_from", "SELECT ticker, fiscal_year, CAST(count(*) FILTER (accn <> latest) AS INT) AS n_carried FROM (SELECT *, max(accn) OVER (PARTITION BY ticker, fiscal_year) AS latest FROM (" + _winner("ticker, fiscal_year", "form IN ('10-K', '10-K/A')") + ") x) y GROUP BY ALL")
def pit4(u):
    w = rs.to_wide(rs.annual_record(u.f_main, registry(u)), ["ticker", "fiscal_year"], ["revenue", "net_income", "capex"])
    w = w.withColumn("accn", F.array_max(F.transform(F.map_values("source_filings"), lambda v: v["accn"])))
    return rs.carried_from(w).select("ticker", "fiscal_year", F.size("carried").alias("n_carried"))


def _pit_ratios(df, u):
    j = df.join(u.company.select("ticker", "sector_class"), "ticker")
    return rat.ratios(j, keep=["ticker", "fiscal_year", "day", "sector_class"]).select("ticker", "fiscal_year", "day", "net_margin", "roa", "asset_turnover")


_PR = "CASE WHEN revenue > 0 THEN net_income / revenue END AS net_margin, CASE WHEN total_assets > 0 THEN net_income / total_assets END AS roa, CASE WHEN sector_class = 'general' AND total_assets > 0 THEN revenue / total_assets END AS asset_turnover"


@query("pit5_metrics_as_of", f"SELECT p.ticker, p.fiscal_year, p.day, {_PR} FROM ox_pit p JOIN si_company c ON c.ticker = p.ticker WHERE present", r="net_margin roa asset_turnover")
def pit5(u):
    return _pit_ratios(rs.as_of_annual(u.known, u.probes), u)


@query("pit6_metrics_history_as_of", f"SELECT p.ticker, p.fiscal_year, p.day, {_PR} FROM ox_hist p JOIN si_company c ON c.ticker = p.ticker WHERE present", r="net_margin roa asset_turnover")
def pit6(u):
    return _pit_ratios(rs.history_as_of(u.known, u.probes.select("ticker", "day")), u)


@query("pit7_has_snapshots", "SELECT c.ticker, c.ticker IN (SELECT ticker FROM si_known WHERE revenue > 200000) AS has_snapshots FROM si_company c")
def pit7(u):
    return rs.has_snapshots(u.known.where(F.col("revenue") > 200000), u.company)


@query("pit8_list_vintages", "SELECT ticker, fiscal_year, filed, accn, field, val FROM (" + _winner("ticker, fiscal_year, accn, filed", "form IN ('10-K', '10-K/A')").replace(", arg_max(accn, " + _ORD + ") AS accn", "") + ") x WHERE fiscal_year = 1999")
def pit8(u):
    v = rs.vintages(u.f_main, registry(u)).withColumn("accn", F.col("filing"))
    return rs.list_vintages(v, 1999).select("ticker", "fiscal_year", "filed", "accn", "field", "val")
