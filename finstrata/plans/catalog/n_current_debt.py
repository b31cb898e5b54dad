"""FCT-10 and FCT-11: current debt in its parts, before a refinancing, and with its paper inside."""

from pyspark.sql import functions as F

from finstrata.operators import current_debt as cd
from finstrata.plans import standin
from finstrata.plans.catalog import i_facts as I
from finstrata.plans.catalog._core import query

R = standin.RELATIONS
# Small round figures, so that lines often agree, make one another up or fill the current liabilities.
_V = "CAST(1000 * (CAST(l_quantity AS INT) % {n}) AS DOUBLE)"
_SERIES = (
    ((cd.BORROWINGS, cd.MATURITIES[0], cd.MATURITIES[1], cd.APART, cd.OWN_TOTAL, cd.CURRENT, cd.BALANCE_TOTAL), 4),
    ((cd.PAPER, "LinesOfCreditCurrent", cd.TRADE[0], cd.ACCRUED_PAY, cd.TAXES[1], cd.PAYABLES_AND_ACCRUALS, cd.OWN_DEBT_AND_LEASES), 3),
    ((cd.REFINANCED, cd.BORROWINGS, cd.DEBT, cd.MATURITIES[0], cd.NONCURRENT[0], cd.BORROWINGS, cd.TOTAL), 5))
R["si_f_current"] = " UNION ALL ".join(f"SELECT * FROM ({I._facts(tags, True, val=_V.format(n=n))}) x{i}" for i, (tags, n) in enumerate(_SERIES))
R["si_f_currentd"] = """SELECT ticker, tag, unit, start, "end", max(val) AS val, accn, form, filed FROM si_f_current GROUP BY ticker, tag, unit, start, "end", accn, form, filed"""


def currentd(u):
    """The rows of ``si_f_currentd``: a line meets its order once and lies by company, order month and shipping year
    before it becomes three facts; texts are made of the keys once the facts are unique."""
    tags = list(dict.fromkeys(t for of, _ in _SERIES for t in of))
    month, year = F.trunc(F.col("o_orderdate").cast("date"), "month"), F.trunc(F.col("l_shipdate").cast("date"), "year")
    slot = F.when(F.col("l_linenumber").between(1, 7), F.col("l_linenumber")).otherwise(7).cast("int")
    lines = u.table("lineitem").select("l_orderkey", "l_suppkey", year.alias("y"), slot.alias("slot"), F.col("l_quantity").cast("int").alias("q"))
    orders = u.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), month.alias("m"))
    key = ["l_suppkey", "m", "y"]
    lines = lines.join(orders.hint("shuffle_hash"), "l_orderkey").select(*key, "slot", "q").repartition(*key)
    literal = lambda values: F.array(*map(F.lit, values))
    each = lines.select("*", F.explode(literal(range(len(_SERIES)))).alias("i"))
    tag = F.element_at(literal([tags.index(t) for of, _ in _SERIES for t in of]), F.col("i") * 7 + F.col("slot"))
    facts = each.groupBy(*key, tag.alias("t")).agg(F.max(F.col("q") % F.element_at(literal([n for _, n in _SERIES]), F.col("i") + 1)).alias("v"))
    ticker = F.concat(F.lit("S"), "l_suppkey")
    form = F.when(F.month("m") % 3 == 0, "10-K").when(F.month("m") % 3 == 1, "10-Q").otherwise("10-K/A")
    return facts.select(ticker.alias("ticker"), F.element_at(literal(tags), F.col("t") + 1).alias("tag"), F.lit("USD").alias("unit"), F.lit(None).cast("date").alias("start"),
                        F.date_sub(F.add_months("y", 12), 1).alias("end"), (F.col("v") * 1000).cast("double").alias("val"), F.concat(ticker, F.lit("-"), F.col("m").cast("string")).alias("accn"),
                        form.alias("form"), F.add_months("m", 15).alias("filed"))


standin.BUILT["si_f_currentd"] = currentd

_FORMS = {"annual": "('10-K', '10-K/A')", "quarterly": "('10-K', '10-K/A', '10-Q')"}
_COLS = ", ".join(f"max(val) FILTER (tag = '{t}') AS {n}" for t, n in {**cd._NAMES, cd.REFINANCED: "moved"}.items())
R["ox_debt"] = f"""SELECT *, coalesce(apart, n) AS nc, t IS NOT NULL AND apart IS NULL AND NOT coalesce({I._agr('t', 'n')}, false) AS kept, form LIKE '10-K%' AS annual,
 greatest(coalesce(m0, 0), coalesce(m1, 0)) AS m, greatest(coalesce(p0, 0), 0) + greatest(coalesce(p4, 0), 0) AS parts FROM (
 SELECT ticker, accn, "end", max(form) AS form, max(filed) AS filed, {_COLS}, coalesce({', '.join(f"max(val) FILTER (tag = '{x}')" for x in cd.NONCURRENT)}) AS n FROM si_f_currentd GROUP BY ticker, accn, "end") x"""
R["ox_debt2"] = """SELECT *, kept OR (bool_or(kept AND annual) OVER d AND NOT bool_or(apart IS NOT NULL AND annual) OVER d) AS total, CASE WHEN m0 > 0 AND m1 > 0 THEN greatest(m0, m1) WHEN m0 > 0 THEN m0 WHEN m1 > 0 THEN m1 END AS hi,
 CASE WHEN m0 > 0 AND m1 > 0 THEN least(m0, m1) WHEN m0 > 0 THEN m0 ELSE m1 END AS lo, greatest(coalesce(trade0, 0), 0) AS trade, greatest(coalesce(tax1, 0), 0) AS tax, greatest(coalesce(pay, 0), 0) AS py, greatest(coalesce(emp, 0), 0) AS em
 FROM ox_debt WINDOW d AS (PARTITION BY ticker, "end")"""
_TOLD = lambda t, strict: f"""WHEN {t} IS NOT NULL AND nc IS NOT NULL AND least(abs({t} - nc - sb), abs({t} - nc - sb - hi)) <= 0.005 * abs({t}) AND (abs({t} - nc - sb - hi) < abs({t} - nc - sb) OR {'false' if strict else 'true'}) THEN abs({t} - nc - sb) < abs({t} - nc - sb - hi)"""
_LINES = "CASE WHEN greatest(CASE WHEN trade > 0 THEN trade + em + tax ELSE py + tax END, py) <= lc THEN greatest(CASE WHEN trade > 0 THEN trade + em + tax ELSE py + tax END, py) ELSE 0 END"
R["ox_debt3"] = f"""SELECT *, CASE WHEN lo <> hi AND {I._agr('hi', 'sb + lo')} THEN hi ELSE sb + hi END AS val, CASE {_TOLD('own', False)} {_TOLD('own2', True)} WHEN lc > 0 AND sb + hi + {_LINES} > lc * 1.005 THEN true
 WHEN parts > 0 AND {I._agr('sb', 'parts')} AND (sb <> hi OR EXISTS (SELECT 1 FROM ox_debt2 o WHERE o.ticker = w.ticker AND o.accn = w.accn AND o."end" <> w."end" AND o.sb IS NOT NULL AND o.parts > 0 AND {I._agr('o.sb', 'o.parts')} AND o.m > 0 AND o.m <> o.sb)) THEN false
 WHEN parts > 0 AND {I._agr('sb', 'hi + parts')} THEN true WHEN sb - hi >= 0 AND sb - hi <= 0.01 * sb THEN true END AS held FROM ox_debt2 w WHERE sb >= 0 AND dc IS NULL AND hi IS NOT NULL AND NOT total"""
R["ox_debt4"] = f"""SELECT *, coalesce(held, NOT annual AND sb >= hi * 0.98 AND y IS NOT NULL AND (EXISTS (SELECT 1 FROM ox_debt3 a WHERE a.ticker = d.ticker AND a."end" = d.y AND a.annual AND a.held)
 OR EXISTS (SELECT 1 FROM ox_debt2 q JOIN ox_debt2 k ON k.ticker = q.ticker AND k."end" = q."end" AND k.annual AND {I._agr('k.dc', 'q.sb')} WHERE q.ticker = d.ticker AND q.accn = d.accn AND q."end" = d.y)), false) AS inside
 FROM (SELECT *, (SELECT max(b."end") FROM ox_debt2 b WHERE b.ticker = c.ticker AND b.annual AND b.bs IS NOT NULL AND b."end" <= c."end") AS y FROM ox_debt3 c) d"""


def _made(view: str) -> str:
    return f"""SELECT c.ticker, c.accn, c."end", c.val FROM ox_debt4 c JOIN (SELECT ticker, "end", accn FROM (SELECT ticker, "end", accn, form, filed FROM ox_debt2 WHERE dc IS NOT NULL UNION SELECT ticker, "end", accn, form, filed FROM ox_debt4) z
 WHERE form IN {_FORMS[view]} QUALIFY row_number() OVER (PARTITION BY ticker, "end" ORDER BY filed DESC, accn DESC) = 1) l ON l.ticker = c.ticker AND l."end" = c."end" AND l.accn = c.accn WHERE NOT inside"""


_ON = lambda a: " AND ".join(f'{a}.{c} = f.{c}' for c in ("ticker", "accn", '"end"'))

for _view in ("annual", "quarterly"):
    @query(f"fct10_current_debt_{_view}", f"""SELECT ticker, tag, "end", accn, val FROM si_f_currentd f WHERE NOT (tag = '{cd.MATURITIES[1]}' AND EXISTS (SELECT 1 FROM ox_debt2 w WHERE {_ON('w')} AND w.total))
UNION ALL SELECT ticker, '{cd.DEBT}', "end", accn, val FROM ({_made(_view)}) m""")
    def fct10(u, view=_view):
        return cd.current_debt_combined(u.f_currentd, view).select("ticker", "tag", "end", "accn", "val")

    @query(f"fct11_current_debt_{_view}", f"""WITH made AS ({_made(_view)}), h AS (SELECT *, CASE WHEN dc IS NOT NULL THEN CASE WHEN dc >= m * 0.995 THEN dc END ELSE sb END AS holder FROM ox_debt2),
src AS (SELECT h.ticker, h."end", h.holder FROM h LEFT JOIN made m ON m.ticker = h.ticker AND m.accn = h.accn AND m."end" = h."end" WHERE form IN {_FORMS[_view]} AND (dc IS NOT NULL OR m.val IS NOT NULL OR sb IS NOT NULL)
 QUALIFY row_number() OVER (PARTITION BY h.ticker, h."end" ORDER BY CASE WHEN dc IS NOT NULL OR m.val IS NOT NULL THEN 0 ELSE 1 END, filed DESC, h.accn DESC) = 1)
SELECT f.ticker, tag, f."end", accn, CASE WHEN tag = '{cd.PAPER}' AND val > 0 AND coalesce(s.holder, 0) >= val * 0.98 THEN 0 ELSE val END AS val FROM si_f_currentd f LEFT JOIN src s ON s.ticker = f.ticker AND s."end" = f."end"
WHERE NOT (tag = '{cd.DEBT}' AND EXISTS (SELECT 1 FROM ox_debt2 w WHERE {_ON('w')} AND moved > 0 AND {I._agr('dc - moved', 'sb')}))""")
    def fct11(u, view=_view):
        combined, _ = cd.current_debt_combinations(u.f_currentd, view)
        return cd.current_debt_set_aside(u.f_currentd, view, combined).select("ticker", "tag", "end", "accn", "val")


@query("fct11_current_debt_vintage", f"""WITH h AS (SELECT *, coalesce(dc, sb, m0, m1) IS NOT NULL AS shows, CASE WHEN dc IS NOT NULL THEN CASE WHEN dc >= m * 0.995 THEN dc END ELSE sb END AS holder FROM ox_debt2 WHERE annual AND (dc IS NOT NULL OR sb IS NOT NULL OR m0 IS NOT NULL OR m1 IS NOT NULL OR p0 IS NOT NULL)),
n AS (SELECT *, row_number() OVER (PARTITION BY ticker, "end" ORDER BY filed, accn) AS k FROM h),
v AS (SELECT n.*, (SELECT arg_max(coalesce(b.holder, 0), b.k) FROM n b WHERE b.ticker = n.ticker AND b."end" = n."end" AND b.k <= n.k AND b.shows) AS source, (SELECT arg_max(b.p0, b.k) FROM n b WHERE b.ticker = n.ticker AND b."end" = n."end" AND b.k < n.k AND b.p0 IS NOT NULL) AS paper FROM n)
SELECT f.ticker, tag, f."end", f.accn, CASE WHEN tag = '{cd.PAPER}' AND v.p0 > 0 AND v.source >= v.p0 * 0.98 THEN 0 ELSE f.val END AS val FROM si_f_currentd f LEFT JOIN v ON {_ON('v')}
WHERE NOT (tag = '{cd.DEBT}' AND EXISTS (SELECT 1 FROM ox_debt2 w WHERE {_ON('w')} AND moved > 0 AND {I._agr('dc - moved', 'sb')}))
UNION ALL SELECT ticker, '{cd.PAPER}', "end", accn, CASE WHEN coalesce(holder, 0) >= paper * 0.98 THEN 0 ELSE paper END FROM v WHERE p0 IS NULL AND shows AND paper > 0""")
def fct11v(u):
    return cd.current_debt_set_aside(u.f_currentd, "vintage").select("ticker", "tag", "end", "accn", "val")
