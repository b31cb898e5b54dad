"""FCT-9, INS-3 and VAL-21."""

from pyspark.sql import functions as F

from finstrata.operators import facts as fx
from finstrata.operators import titles
from finstrata.plans import standin
from finstrata.plans.catalog import i_facts as I
from finstrata.plans.catalog._core import query

R = standin.RELATIONS
R["si_f_totals"] = I._facts(["LongTermDebt", "LongTermNotesPayable", "DebtCurrent", "ShortTermBorrowings", "LongTermDebtCurrent", "SeniorLongTermNotes", "LongTermDebtNoncurrent"], True, val="CAST(floor(l_extendedprice / 20000) AS DOUBLE) * 1000 + 1000")
R["ox_totals"] = "SELECT ticker, accn, \"end\", " + ", ".join(f"max(val) FILTER (tag = '{t}') AS {n}" for t, n in (("LongTermDebt", "t"), ("LongTermNotesPayable", "n0"), ("DebtCurrent", "dc"), ("ShortTermBorrowings", "sb"), ("LongTermDebtCurrent", "m"), ("SeniorLongTermNotes", "l"), ("LongTermDebtNoncurrent", "own"))) + " FROM si_f_totals GROUP BY ALL"
_LINE = f"n0 IS NULL AND own IS NULL AND l IS NOT NULL AND (coalesce(dc > 0 AND {I._agr('l + dc', 't')}, false) OR coalesce(m > 0 AND {I._agr('l + m', 't')}, false))"
R["ox_aside"] = f"""SELECT ticker, accn, "end", isline FROM (SELECT *, {_LINE} AS isline, coalesce(n0, CASE WHEN {_LINE} THEN l END) AS n FROM ox_totals WHERE t IS NOT NULL) x WHERE n IS NOT NULL AND (t < n OR
 CASE WHEN dc IS NOT NULL THEN dc > 0 WHEN sb > 0 AND sb = m THEN true WHEN sb IS NULL AND m > 0 THEN true ELSE coalesce(m > 0 AND n + coalesce(sb, 0) + m >= 0.95 * t, false) END)"""


@query("fct9_debt_totals_set_aside", """SELECT ticker, tag, "end", val, accn FROM si_f_totals f WHERE tag <> 'LongTermDebt' OR NOT EXISTS (SELECT 1 FROM ox_aside a WHERE a.ticker = f.ticker AND a.accn = f.accn AND a."end" = f."end")
UNION ALL SELECT f.ticker, 'LongTermDebtNoncurrent', f."end", f.val, f.accn FROM si_f_totals f JOIN ox_aside a ON a.ticker = f.ticker AND a.accn = f.accn AND a."end" = f."end" WHERE isline AND tag = 'SeniorLongTermNotes'""")
def fct9(u):
    return fx.debt_totals_set_aside(u.f_totals).select("ticker", "tag", "end", "val", "accn")


# Titles put together from what stands before a chief's name, the name, and what follows it; each part says whether the chief sits.
_BEFORE = [("", True), ("President & ", True), ("Chairman, ", True), ("Interim ", True), ("Founder/", True), ("Former ", False), ("Advisor to the ", False), ("Deputy ", False), ("Office of the ", False), ("Ex-", False), ("Retired VP and ", False)]
_CHIEF = ["CEO", "CFO", "C.E.O.", "Chief Executive Officer", "chief financial officer", "Chief Exec. Ofcr", "CHIEF FIN & LEGAL OFFICER"]
_AFTER = [("", True), (", Treasurer", True), (" & Director", True), (" and Secretary, Canada", True), (" of the Company", True), (" (Former President)", True), ("; Board Member", True), (" of Retail", False), (", Europe", False),
          (" - Asia Pacific", False), (" (retired)", False), (" & VP at Subsidiary", False), ("-Elect", False), (" & Secretary - Mills", False), (" Emeritus", False)]
_pick = lambda parts, n: f"CASE {n} % {len(parts)} " + " ".join(f"WHEN {i} THEN '{x[0] if isinstance(x, tuple) else x}'" for i, x in enumerate(parts)) + " END"
_sits = lambda parts, n: f"{n} % {len(parts)} IN ({', '.join(str(i) for i, x in enumerate(parts) if x[1])})"
_B, _C, _A = "c_custkey", f"CAST(floor(c_custkey / {len(_BEFORE)}) AS INT)", f"(CAST(floor(c_custkey / {len(_BEFORE) * len(_CHIEF)}) AS INT) + c_custkey)"
R["si_titles"] = f"""SELECT c_custkey AS customer, concat('T', CAST(c_nationkey AS VARCHAR(4))) AS ticker,
  CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 19 = 0 THEN concat('Vice President of ', CAST(c_nationkey AS VARCHAR(4))) WHEN c_custkey % 13 = 0 THEN concat('CEO of T', CAST(c_nationkey + c_custkey % 2 AS VARCHAR(4)))
    ELSE concat({_pick(_BEFORE, _B)}, {_pick(_CHIEF, _C)}, {_pick(_AFTER, _A)}) END AS officer_title,
  c_custkey % 17 <> 0 AND c_custkey % 19 <> 0 AND CASE WHEN c_custkey % 13 = 0 THEN c_custkey % 2 = 0 ELSE {_sits(_BEFORE, _B)} AND {_sits(_AFTER, _A)} END AS sits FROM customer"""


@query("ins3_is_ceo_cfo", "SELECT customer, officer_title, sits AS is_ceo_cfo FROM si_titles")
def ins3(u):
    return titles.classify_titles(u.titles.drop("sits")).select("customer", "officer_title", "is_ceo_cfo")


@query("val21_compute_all", "SELECT 'valuations' AS name, ticker, count(*) AS rows FROM ox_models GROUP BY ticker UNION ALL SELECT 'valuation_history', ticker, count(*) FROM ox_multiples GROUP BY ticker UNION ALL SELECT 'warning_signs', ticker, count(*) FROM ox_signs GROUP BY ticker UNION ALL SELECT 'per_share_annual', ticker, count(*) FROM ox_rows GROUP BY ticker UNION ALL SELECT 'valuation_indicators', ticker, count(*) FROM ox_indicators GROUP BY ticker UNION ALL SELECT 'quality_scores', ticker, 1 FROM ox_cur")
def val21(u):
    from finstrata.plans.recompute import compute_all
    t = compute_all(u)
    out = None
    for n in ("valuations", "valuation_history", "warning_signs", "per_share_annual", "valuation_indicators", "quality_scores"):
        g = t[n].groupBy("ticker").agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "ticker", "rows")
        out = g if out is None else out.unionByName(g)
    return out


# Every report gives a year the same figures, but the last of every third year turns net income's sign and states sales in thousands.
R["si_f_repair"] = I._facts(["Revenues", "NetIncomeLoss", "Revenues", "NetIncomeLoss", "Revenues", "NetIncomeLoss", "Assets"], False,
    val="(CAST(1000000 AS DOUBLE) * (1 + l_suppkey % 7)) * CASE WHEN o_orderdate >= TIMESTAMP '2001-06-01 00:00:00' AND o_orderdate < TIMESTAMP '2001-07-01 00:00:00' AND year(l_shipdate) % 3 = 0 THEN CASE WHEN l_linenumber IN (2, 4) OR l_linenumber = 6 THEN -1 ELSE 0.001 END ELSE 1 END")
R["ox_repair"] = "SELECT ticker, CAST(year(\"end\") AS INT) AS fiscal_year, CASE tag WHEN 'Revenues' THEN 'revenue' ELSE 'net_income' END AS field, max(filed) AS last, min(filed) AS first, arg_max(val, CAST(filed AS VARCHAR) || accn) AS val, CAST(1000000 AS DOUBLE) * (1 + CAST(substr(ticker, 2) AS INT) % 7) AS base FROM si_f_repair WHERE form IN ('10-K', '10-K/A') AND tag <> 'Assets' GROUP BY ALL"


@query("res7_restore_agreed_figures", "SELECT ticker, fiscal_year, field, CASE WHEN val <> base AND first < last THEN base ELSE val END AS val, CASE WHEN val = base OR first = last THEN NULL WHEN field = 'revenue' THEN 'scale x10^-3' ELSE 'sign flip' END AS repair FROM ox_repair", r="val")
def res7(u):
    from finstrata.operators import resolve as rs
    r = I.registry(u)
    return rs.restore_agreed_figures(rs.annual_record(u.f_repair, r), u.f_repair, r).where(F.col("field").isin("revenue", "net_income")).select("ticker", "fiscal_year", "field", "val", "repair")
