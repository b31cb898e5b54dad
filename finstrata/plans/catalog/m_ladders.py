"""FCT-12 and RES-15..17: parts under a total's tag, rungs on their year's basis and scale, debt lines quarters name otherwise."""

from pyspark.sql import functions as F

from finstrata.operators import displaced, ladders
from finstrata.plans import standin
from finstrata.plans.catalog import i_facts as I
from finstrata.plans.catalog._core import query

R = standin.RELATIONS

# ---- FCT-12: a year's D&A is one figure; the tag that ranks first carries six tenths of it from some companies' later filings on.
_DA = displaced.TOTALS + [displaced.DEPRECIATION, *displaced.AMORTIZATION]
R["si_da_years"] = I._facts([_DA[0], _DA[3], _DA[3], _DA[1], _DA[4], _DA[5], _DA[6]], False,
                            val="CAST(floor((100 + l_suppkey % 50 + year(l_shipdate) % 7) * 1000 * CASE WHEN l_linenumber = 1 AND l_suppkey % 3 > 0 THEN 0.6 WHEN l_linenumber = 4 THEN 0.9 WHEN l_linenumber > 5 THEN 0.2 + l_suppkey % 2 ELSE 1.0 END) AS DOUBLE)")
R["si_f_da"] = """SELECT * FROM si_da_years UNION ALL
SELECT ticker, tag, unit, start, CAST(start + INTERVAL 181 DAY AS DATE) AS "end", floor(val / 2) AS val, accn, form, filed FROM si_da_years WHERE year(start) % 2 = 0"""
_RANK = "CASE tag " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(displaced.TOTALS)) + " END"
R["ox_da"] = f"""SELECT *, min(filed) OVER g AS whenf, count(*) OVER g AS n FROM (SELECT ticker, accn, start, "end", tag, max(val) AS val, max(filed) AS filed, {_RANK} AS rk FROM si_f_da WHERE {_RANK} IS NOT NULL GROUP BY ALL) x
WINDOW g AS (PARTITION BY ticker, accn, start, "end")"""
_LESS = lambda a, b: f"({a} < {b} AND NOT {I._agr(a, b)})"
_SAME = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in ("ticker", "accn", "start", '"end"'))
_SPAN = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in ("ticker", "start", '"end"'))
R["ox_da_shown"] = f"""SELECT e.ticker, e.tag, o.tag AS other, o.rk AS ork, min(e.whenf) AS since FROM ox_da e JOIN ox_da o ON {_SAME('e', 'o')} AND e.tag <> o.tag AND {_LESS('e.val', 'o.val')}
WHERE EXISTS (SELECT 1 FROM ox_da f WHERE {_SPAN('f', 'e')} AND f.accn <> e.accn AND f.n = 1 AND f.tag = o.tag AND f.filed < e.whenf AND {I._agr('f.val', 'o.val')}) GROUP BY ALL"""
R["ox_da_aside0"] = f"""SELECT e.ticker, e.accn, e.start, e."end", e.tag, o.tag AS other FROM ox_da e JOIN ox_da_shown s ON s.ticker = e.ticker AND s.tag = e.tag AND s.since <= e.whenf
LEFT JOIN ox_da o ON {_SAME('o', 'e')} AND o.tag = s.other
WHERE NOT EXISTS (SELECT 1 FROM ox_da k WHERE {_SAME('k', 'e')} AND k.tag NOT IN (e.tag, s.other) AND k.rk < s.ork)
AND CASE WHEN o.tag IS NOT NULL THEN {_LESS('e.val', 'o.val')} AND o.val > coalesce((SELECT max(a.val) FROM si_f_da a WHERE {_SAME('a', 'e')} AND a.tag IN ('{displaced.AMORTIZATION[0]}', '{displaced.AMORTIZATION[1]}')), 0)
 ELSE EXISTS (SELECT 1 FROM ox_da f WHERE {_SPAN('f', 'e')} AND f.accn <> e.accn AND f.tag = s.other AND f.whenf <= e.whenf AND {_LESS('e.val', 'f.val')}) END"""
R["ox_da_aside"] = f"""SELECT DISTINCT a.* FROM ox_da_aside0 a WHERE date_diff('day', a.start, a."end") >= 350 OR NOT EXISTS (
 SELECT 1 FROM (SELECT * FROM ox_da WHERE date_diff('day', start, "end") < 350 QUALIFY row_number() OVER (PARTITION BY ticker, tag, start, "end" ORDER BY filed DESC, accn DESC) = 1) l
 WHERE l.ticker = a.ticker AND l.tag = a.tag AND l.start = a.start AND NOT EXISTS (SELECT 1 FROM ox_da_aside0 b WHERE {_SAME('b', 'l')} AND b.tag = l.tag))"""


@query("fct12_da_totals_displaced", f"""SELECT ticker, tag, start, "end", val, accn FROM si_f_da f WHERE NOT EXISTS (SELECT 1 FROM ox_da_aside a WHERE {_SAME('a', 'f')} AND a.tag = f.tag)
UNION ALL SELECT DISTINCT a.ticker, a.tag, a.start, a."end", f.val, a.accn FROM ox_da_aside a JOIN si_f_da f ON {_SAME('f', 'a')} AND f.tag = a.other""")
def fct12(u):
    return displaced.da_totals_displaced(u.f_da).select("ticker", "tag", "start", "end", "val", "accn")


# ---- RES-15: rungs from before and after the declared splits; every second year's annual figure is filed two years late.
R["si_y_rungs"] = """
SELECT ticker, field, CAST(date_trunc('year', period_end) AS DATE) AS start, period_end AS "end", val, is_count,
  CAST(period_end + CASE WHEN fiscal_quarter = 4 AND fiscal_year % 2 = 0 THEN INTERVAL 700 DAY WHEN fiscal_quarter = 4 THEN INTERVAL 70 DAY ELSE INTERVAL 40 DAY END AS DATE) AS filed FROM (
SELECT ticker, period_end, fiscal_year, fiscal_quarter, 'weighted_avg_shares_diluted' AS field, CAST(weighted_avg_shares_diluted AS DOUBLE) AS val, true AS is_count FROM si_quarterly
UNION ALL SELECT ticker, period_end, fiscal_year, fiscal_quarter, 'eps_diluted', CAST(eps_diluted AS DOUBLE), false FROM si_quarterly WHERE eps_diluted IS NOT NULL) x
"""
_LEVEL = lambda t, d: f"coalesce((SELECT product(s.ratio) FROM si_declared s WHERE s.ticker = {t} AND s.date <= {d}), 1.0)"


def _restatements(u):
    return u.declared.select("ticker", F.col("date").alias("through"), "ratio")


@query("res15_rungs_on_year_basis", f"""SELECT ticker, field, start, "end", CASE WHEN is_count THEN val * lv / own ELSE val / (lv / own) END AS val, lv AS level FROM (
SELECT r.*, {_LEVEL('r.ticker', 'coalesce(a.anchor, r.filed)')} AS lv, {_LEVEL('r.ticker', 'r.filed')} AS own FROM si_y_rungs r LEFT JOIN (
 SELECT ticker, field, "end", max(anchor) AS anchor FROM (SELECT r.ticker, r.field, r."end", y.anchor FROM si_y_rungs r JOIN (
   SELECT ticker, field, start, coalesce(max(filed) FILTER (date_diff('day', start, "end") >= 350), max(filed)) AS anchor FROM si_y_rungs GROUP BY ALL HAVING count(*) >= 2) y
   ON y.ticker = r.ticker AND y.field = r.field AND y.start = r.start) z GROUP BY ALL) a ON a.ticker = r.ticker AND a.field = r.field AND a."end" = r."end") w""", r="val level")
def res15(u):
    return ladders.rungs_on_year_basis(u.y_rungs, _restatements(u)).select("ticker", "field", "start", "end", "val", "level")


@query("res15_instants_on_year_basis", f"""SELECT ticker, "end", val * lv / own AS val, lv AS level FROM (SELECT ticker, "end", val, {_LEVEL('r.ticker', 'r.top')} AS lv, {_LEVEL('r.ticker', 'r.filed')} AS own FROM (
SELECT *, max(filed) OVER (PARTITION BY ticker, year("end")) AS top FROM si_y_rungs WHERE is_count) r) x""", r="val level")
def res15i(u):
    c = u.y_rungs.where("is_count").withColumn("fiscal_year", F.year("end"))
    return ladders.instants_on_year_basis(c, _restatements(u)).select("ticker", "end", "val", "level")


# ---- RES-16: a third of the rungs state their count in thousands, every fourth lacks EPS, every ninth has it off by a thousand.
R["si_s_rungs"] = """
SELECT ticker, CAST(date_trunc('year', period_end) AS DATE) AS start, period_end AS "end", true_count * CASE WHEN k % 3 = 0 THEN 0.001 ELSE 1.0 END AS val, net_income,
  CASE WHEN k % 4 <> 1 AND net_income <> 0 THEN net_income / true_count * CASE WHEN k % 9 = 4 THEN 1000.0 ELSE 1.0 END END AS eps
FROM (SELECT q.ticker, period_end, CAST(net_income AS DOUBLE) AS net_income, CAST(90000 + 250 * nation_no AS DOUBLE) AS true_count, CAST(revenue AS BIGINT) AS k FROM si_quarterly q JOIN si_company c ON c.ticker = q.ticker) x
"""
_POW = lambda v, i: f"""CASE WHEN {v} > 0 AND {i} > 0 THEN (SELECT CASE WHEN min(abs({v} * s / {i} - 1)) <= 0.1 AND arg_min(s, abs({v} * s / {i} - 1)) <> 1 THEN arg_min(s, abs({v} * s / {i} - 1)) END FROM (VALUES (1e-6), (1e-3), (1.0), (1e3), (1e6)) p(s)) END"""
R["ox_s1"] = f"""SELECT r.*, n.y, abs(nullif(net_income, 0) / nullif(eps, 0)) AS implied FROM si_s_rungs r JOIN (
 SELECT a.ticker, a.start, a."end", coalesce((SELECT min(b.start) FROM si_s_rungs b WHERE b.ticker = a.ticker AND b."end" = a."end" AND (SELECT count(*) FROM si_s_rungs c WHERE c.ticker = b.ticker AND c.start = b.start) >= 2), a.start) AS y FROM si_s_rungs a) n
 ON n.ticker = r.ticker AND n.start = r.start AND n."end" = r."end\""""
R["ox_s2"] = f"SELECT *, {_POW('val', 'implied')} AS p FROM ox_s1"
R["ox_s3"] = """SELECT ticker, start, "end", y, implied, val * CASE WHEN p IS NOT NULL AND EXISTS (SELECT 1 FROM ox_s2 o WHERE o.ticker = a.ticker AND o.y = a.y AND o."end" <> a."end" AND o.val > 0 AND a.val * a.p / o.val BETWEEN 0.5 AND 2) THEN p ELSE 1 END AS val FROM ox_s2 a"""
R["ox_s4"] = "SELECT *, coalesce(abs(val / implied - 1) <= 0.1, false) AS ok FROM ox_s3"
R["ox_s5"] = "SELECT a.*, (SELECT median(b.val) FROM ox_s4 b WHERE b.ticker = a.ticker AND b.y = a.y AND b.ok) AS ref FROM ox_s4 a"


@query("res16_rungs_on_one_scale", f"SELECT ticker, start, \"end\", CASE WHEN ok THEN val ELSE val * coalesce({_POW('val', 'ref')}, 1) END AS val FROM ox_s5", r="val")
def res16(u):
    s = u.s_rungs
    key = ["ticker", "start", "end"]
    part = lambda c: s.where(F.col(c).isNotNull()).select(*key, F.col(c).alias("val"))
    return ladders.rungs_on_one_scale(s.select(*key, "val"), part("net_income"), part("eps"))


# ---- RES-17: annual reports show notes payable, quarterly ones the same figure as notes and loans or under a total's name.
R["si_f_lines"] = I._facts(["LongTermNotesPayable", "LongTermNotesAndLoans", "SeniorNotes", "LongTermDebtCurrent", "DebtInstrumentFaceAmount", "NotesPayableRelatedParties", "LongTermLoansPayable"], True,
                           val="CAST(1000 * (10 + l_suppkey % 9 + year(l_shipdate) % 5) + CASE WHEN l_linenumber = 7 AND l_suppkey % 2 = 0 THEN 500 ELSE 0 END AS DOUBLE)")
R["si_line_years"] = "SELECT ticker, \"end\" AS period_end, max(val) AS long_term_debt, 'LongTermNotesPayable' AS tag FROM si_f_lines WHERE tag = 'LongTermNotesPayable' AND form LIKE '10-K%' AND CAST(substring(ticker, 2) AS INT) % 7 > 0 GROUP BY ticker, \"end\""
R["si_line_quarters"] = "SELECT ticker, \"end\" AS period_end, CASE WHEN year(\"end\") % 6 = 0 THEN 1.0 END AS long_term_debt, CASE WHEN year(\"end\") % 2 = 0 THEN 7.0 ELSE 0.0 END AS short_term_debt FROM si_f_lines GROUP BY ticker, \"end\""
_Q17 = "('LongTermNotesPayable', 'LongTermNotesAndLoans', 'SeniorNotes', 'NotesPayableRelatedParties', 'LongTermLoansPayable')"


@query("res17_quarter_debt_lines", f"""WITH f AS (SELECT ticker, accn, form, filed, "end", tag, max(val) AS val FROM si_f_lines GROUP BY ALL),
fig AS (SELECT DISTINCT f.ticker, f."end", f.val FROM f JOIN si_line_years y ON y.ticker = f.ticker AND y.period_end = f."end" AND y.tag = f.tag WHERE form LIKE '10-K%' AND val > 0),
apart AS (SELECT DISTINCT f.ticker, f."end" FROM f JOIN si_line_years y ON y.ticker = f.ticker AND y.period_end = f."end" WHERE form LIKE '10-K%' AND f.tag = 'LongTermDebtCurrent' AND val > 0),
q AS (SELECT * FROM f WHERE form LIKE '10-Q%' AND tag IN {_Q17}),
line AS (SELECT q.ticker, q.accn, q.tag, bool_or(a."end" IS NOT NULL) AS apart FROM q JOIN fig USING (ticker, "end", val) LEFT JOIN apart a ON a.ticker = q.ticker AND a."end" = q."end" GROUP BY ALL),
hit AS (SELECT q.ticker, q."end", q.accn, q.filed, min(q.val) AS v, max(q.val) AS w, min(q.tag) AS tag FROM q JOIN line USING (ticker, accn, tag) JOIN si_line_quarters s ON s.ticker = q.ticker AND s.period_end = q."end" AND s.long_term_debt IS NULL
 WHERE s.short_term_debt = 0 OR starts_with(q.tag, 'LongTerm') OR line.apart GROUP BY ALL HAVING v = w)
SELECT ticker, "end" AS period_end, v AS long_term_debt, tag FROM hit QUALIFY row_number() OVER (PARTITION BY ticker, "end" ORDER BY filed DESC, accn DESC) = 1""")
def res17(u):
    return ladders.quarter_debt_lines(u.f_lines, u.line_years, u.line_quarters)
