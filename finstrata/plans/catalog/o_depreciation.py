"""FCT-13: depreciation and amortisation of intangibles as one figure."""

from finstrata import registry as reg
from finstrata.operators import depreciation as dp
from finstrata.plans import standin
from finstrata.plans.catalog import i_facts as I
from finstrata.plans.catalog._core import query

R = standin.RELATIONS
# Small round figures: lines often agree, add up or exceed one another; revenue tells whether two filings are on one basis.
R["si_dp_years"] = I._facts([dp.TOTALS[0], dp.COMBINED, dp.DEPRECIATION, dp.AMORTIZATION[0], dp.AMORTIZATION[1], dp.TOTALS[1], reg.TAGS["revenue"][0]], False,
                            val="CAST(CASE WHEN l_linenumber = 7 THEN 9000 ELSE 1000 * (CAST(l_quantity AS INT) % 5) + CASE WHEN l_linenumber = 2 THEN 1000 ELSE 0 END END AS DOUBLE)")
R["si_f_dp"] = """SELECT * FROM si_dp_years UNION ALL
SELECT ticker, tag, unit, start, CAST(start + INTERVAL 181 DAY AS DATE) AS "end", CASE WHEN tag = 'Revenues' THEN val ELSE floor(val / 2000) * 1000 + 1000 END AS val, accn, form, filed FROM si_dp_years"""


def _rank(tags, col="tag"):
    return f"CASE {col} " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(tags)) + " END"


_K = 'ticker, accn, start, "end"'
_SAME = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in ("ticker", "accn", "start", '"end"'))
_SPAN = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in ("ticker", "start", '"end"'))
_AGR = I._agr
R["ox_dp_f"] = f'SELECT {_K}, tag, max(val) AS val, max(filed) AS filed, max(form) AS form FROM si_f_dp GROUP BY {_K}, tag'
R["ox_dp_t"] = f"SELECT *, {_rank(dp.TOTALS)} AS rk FROM ox_dp_f WHERE {_rank(dp.TOTALS)} IS NOT NULL"
R["ox_dp_a"] = f"""SELECT x.*, d.val AS dep FROM (SELECT {_K}, arg_min(val, {_rank(dp.AMORTIZATION)}) AS part, arg_min(filed, {_rank(dp.AMORTIZATION)}) AS by_day, arg_min(form, {_rank(dp.AMORTIZATION)}) AS form,
 list(val) FILTER (val > 0) AS figures, min(val) FILTER (val > 0) AS least FROM ox_dp_f WHERE {_rank(dp.AMORTIZATION)} IS NOT NULL GROUP BY {_K}) x LEFT JOIN ox_dp_f d ON {_SAME('d', 'x')} AND d.tag = '{dp.DEPRECIATION}' WHERE part > 0"""
R["ox_dp_r"] = f"SELECT {_K}, arg_min(val, {_rank(reg.TAGS['revenue'])}) AS rev FROM ox_dp_f WHERE {_rank(reg.TAGS['revenue'])} IS NOT NULL GROUP BY {_K}"
R["ox_dp_made"] = f"""SELECT DISTINCT t.ticker, t.accn, t.start, t."end", t.tag FROM ox_dp_t t JOIN (SELECT *, unnest(figures) AS a FROM ox_dp_a) a ON {_SAME('a', 't')} JOIN ox_dp_t p ON {_SPAN('p', 't')} AND p.filed <= a.by_day
 LEFT JOIN ox_dp_r r1 ON {_SAME('r1', 't')} LEFT JOIN ox_dp_r r2 ON {_SPAN('r2', 't')} AND r2.accn = p.accn
 WHERE {_AGR('p.val', 't.val + a.a')} AND NOT {_AGR('t.val + a.a', 't.val')} AND (p.accn = t.accn OR (a.a >= 0.05 * t.val AND coalesce({_AGR('r1.rev', 'r2.rev')}, false)))"""
R["ox_dp_j"] = f"""SELECT t.*, a.part, a.least, a.dep, a.by_day, m.tag IS NOT NULL AS made, CASE WHEN max(t.val) OVER g > a.part THEN a.part ELSE a.least END AS bar FROM ox_dp_t t JOIN ox_dp_a a ON {_SAME('a', 't')}
 LEFT JOIN ox_dp_made m ON {_SAME('m', 't')} AND m.tag = t.tag WINDOW g AS (PARTITION BY t.ticker, t.accn, t.start, t."end")"""
R["ox_dp_todate"] = f"""SELECT a.* FROM ox_dp_a a WHERE dep IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ox_dp_t t WHERE {_SAME('t', 'a')} AND {_AGR('t.val', 'a.dep')})"""
R["ox_dp_first"] = f"""SELECT ticker, start, "end", min(filed) AS first FROM (SELECT ticker, start, "end", filed FROM ox_dp_f WHERE tag <> '{reg.TAGS['revenue'][0]}' AND {_rank(dp.AMORTIZATION)} IS NULL UNION ALL SELECT ticker, start, "end", by_day FROM ox_dp_a) x GROUP BY ALL"""
R["ox_dp_l"] = f"""SELECT j.*, (val > 0 AND val <= bar) OR coalesce(bar < part AND val > bar AND val < dep + bar AND NOT {_AGR('val', 'dep + bar')}, false) AS low,
 made OR ((coalesce(val < dep AND NOT {_AGR('val', 'dep')}, false) OR (EXISTS (SELECT 1 FROM ox_dp_t p JOIN ox_dp_first f ON {_SPAN('f', 'p')} AND f.first = p.filed WHERE {_SPAN('p', 'j')} AND {_AGR('p.val', 'j.val')}) AND NOT {_AGR('val + least', 'val')}
  AND EXISTS (SELECT 1 FROM ox_dp_todate d WHERE d.ticker = j.ticker AND d.start = j.start AND d."end" < j."end" AND d.by_day <= j.by_day AND d.dep + d.least > j.val AND NOT {_AGR('(d.dep + d.least)', 'j.val')})))
  AND (EXISTS (SELECT 1 FROM ox_dp_j c WHERE c.ticker = j.ticker AND c.tag = j.tag AND c.made AND c.val > c.bar AND c.by_day <= j.by_day)
   OR EXISTS (SELECT 1 FROM ox_dp_t e WHERE {_SAME('e', 'j')} AND e.val > j.val AND (e.val >= coalesce(j.dep, j.val) + j.least OR {_AGR('e.val', '(coalesce(j.dep, j.val) + j.least)')})))) AS a_line FROM ox_dp_j j"""
R["ox_dp_s"] = f"""SELECT *, shown AND val > 0 AND NOT low AND NOT line AND (dep IS NULL OR {_AGR('val', 'dep')}) AS same FROM (SELECT *, bool_or(line AND made) OVER (PARTITION BY ticker, accn, tag) AS shown FROM (
 SELECT *, NOT low AND val > bar AND a_line AS line FROM ox_dp_l) x) y"""
R["ox_dp_n"] = f"""SELECT *, count(*) FILTER (line) OVER g AS nl, count(*) FILTER (same) OVER g AS ns, min(val) FILTER (same) OVER g AS mins, coalesce(dep, first_value(val) OVER (PARTITION BY {_K} ORDER BY NOT line, rk)) + least AS base FROM ox_dp_s WINDOW g AS (PARTITION BY {_K})"""
R["ox_dp_o"] = f"""SELECT *, CASE WHEN nl > 0 THEN CASE WHEN line THEN 1 WHEN same THEN 2 WHEN NOT low AND val < base AND NOT {_AGR('val', 'base')} THEN 3 END
 WHEN ns > 0 THEN CASE WHEN same THEN 1 WHEN NOT low AND val < mins AND NOT {_AGR('val', 'mins')} THEN 2 END END AS ln FROM ox_dp_n"""
R["ox_dp_p"] = f"""SELECT *, CASE WHEN ln IS NOT NULL AND NOT (every AND bool_or(ln IS NOT NULL AND (val >= both_v OR {_AGR('val', 'both_v')})) OVER (PARTITION BY {_K})) THEN ln END AS ln2 FROM (
 SELECT *, bool_and(low OR ln IS NOT NULL) OVER (PARTITION BY {_K}) AS every, coalesce(dep, first_value(val) OVER (PARTITION BY {_K} ORDER BY ln NULLS LAST, rk)) + part AS both_v FROM ox_dp_o) x"""
R["ox_dp_y"] = f"""SELECT ticker, start, so FROM (SELECT a.ticker, a.start, a.by_day, a.accn, EXISTS (SELECT 1 FROM ox_dp_p p WHERE {_SAME('p', 'a')} AND p.ln2 IS NOT NULL) AS so FROM ox_dp_a a WHERE date_diff('day', start, "end") >= 350) x
 QUALIFY row_number() OVER (PARTITION BY ticker, start ORDER BY by_day DESC, accn DESC) = 1"""
R["ox_dp_q"] = """SELECT p.*, CASE WHEN date_diff('day', start, "end") >= 350 OR coalesce((SELECT arg_max(y.so, y.start) FROM ox_dp_y y WHERE y.ticker = p.ticker AND y.start <= p.start), true) THEN ln2 END AS ln3 FROM ox_dp_p p"""
_NAME = "CASE {0} " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(dp.TOTALS)) + " END"


@query("fct13_depreciation_combined", f"""WITH g AS (SELECT a.{_K.replace(', ', ', a.')}, a.part, a.dep, min(q.rk) FILTER (ln3 IS NOT NULL) AS under, arg_min(q.val, q.ln3 * 10 + q.rk) FILTER (ln3 IS NOT NULL) AS lv, arg_min(q.val, q.rk) FILTER (low) AS wv,
 min(q.rk) FILTER (NOT low AND ln3 IS NULL) AS hk, arg_min(q.val, q.rk) FILTER (NOT low AND ln3 IS NULL) AS hv FROM ox_dp_a a LEFT JOIN ox_dp_q q ON {_SAME('q', 'a')} GROUP BY ALL)
SELECT ticker, tag, start, "end", accn, val FROM si_f_dp f WHERE NOT EXISTS (SELECT 1 FROM ox_dp_q q WHERE {_SAME('q', 'f')} AND q.tag = f.tag AND (q.low OR q.ln3 IS NOT NULL))
UNION ALL SELECT * FROM (SELECT ticker, coalesce({_NAME.format('under')}, '{dp.COMBINED}') AS tag, start, "end", accn, CASE WHEN hk IS NOT NULL THEN CASE WHEN under < hk THEN hv END ELSE coalesce(dep, lv, wv) + part END AS val FROM g) z WHERE val IS NOT NULL""")
def fct13(u):
    return dp.depreciation_combined(u.f_dp).select("ticker", "tag", "start", "end", "accn", "val")
