"""SPL, INS and GUR."""

from pyspark.sql import functions as F

from finstrata.operators import funds as g
from finstrata.operators import insiders as ins
from finstrata.operators import splits as sp
from finstrata.plans import standin
from finstrata.plans.catalog._core import query

R = standin.RELATIONS
_SPLIT = "(abs(ratio - 1) >= 1e-9 AND list_bool_or([abs(round(ratio * d) / d - ratio) <= 1e-9 * ratio FOR d IN [1, 2, 3, 4]] || [abs(round(d / ratio) / d - 1 / ratio) <= 1e-9 / ratio FOR d IN [1, 2, 3, 4]]))"
_REST = f"({_SPLIT} AND (ratio >= 1.5 OR ratio <= 1 / 1.5))"


@query("spl1_is_share_split", f"SELECT ticker, date, ratio, {_SPLIT} AS share_split FROM si_splits")
def spl1(u):
    return u.splits.select("ticker", "date", "ratio", sp.is_share_split(F.col("ratio")).alias("share_split"))


@query("spl2_split_product", "SELECT q.ticker, q.period_end - 400 AS after, q.period_end AS through, coalesce(product(ratio), 1) AS factor FROM si_quarterly q LEFT JOIN si_splits s ON s.ticker = q.ticker AND s.date > q.period_end - 400 AND s.date <= q.period_end GROUP BY ALL", r="factor")
def spl2(u):
    p = u.quarterly.select("ticker", F.date_sub("period_end", 400).alias("after"), F.col("period_end").alias("through"))
    return sp.split_product(p, u.splits)


R["ox_filed2"] = 'SELECT ticker, "end" AS period_end, min(filed) AS from_day, max(filed) AS to_day FROM si_facts GROUP BY ALL'


@query("spl3_restated_between", f"SELECT f.ticker, f.period_end, f.from_day, f.to_day, coalesce(product(ratio), 1) AS factor FROM ox_filed2 f LEFT JOIN (SELECT * FROM si_splits WHERE {_REST}) s ON s.ticker = f.ticker AND s.date > from_day AND s.date <= to_day GROUP BY ALL UNION ALL SELECT f.ticker, f.period_end, f.to_day, f.from_day, 1 / coalesce(product(ratio), 1) FROM ox_filed2 f LEFT JOIN (SELECT * FROM si_splits WHERE {_REST}) s ON s.ticker = f.ticker AND s.date > from_day AND s.date <= to_day WHERE from_day <> to_day GROUP BY f.ticker, f.period_end, f.to_day, f.from_day", r="factor")
def spl3(u):
    f = u.facts.groupBy("ticker", F.col("end").alias("period_end")).agg(F.min("filed").alias("from_day"), F.max("filed").alias("to_day"))
    back = f.where(F.col("from_day") != F.col("to_day")).select("ticker", "period_end", F.col("to_day").alias("from_day"), F.col("from_day").alias("to_day"))
    return sp.restated_between(f.unionByName(back), u.splits)


def _figs(u, priced, filed):
    return u.annual.select("ticker", "fiscal_year", F.lit(filed).cast("date").alias("filed_date"), F.lit(priced).cast("date").alias("priced_on"),
                           F.col("eps_diluted").alias("eps"), F.col("weighted_avg_shares_diluted").alias("shares"))


def _fig_sql(cond, op, op2):
    return f"SELECT a.ticker, a.fiscal_year, eps_diluted {op} coalesce(f, 1) AS eps, weighted_avg_shares_diluted {op2} coalesce(f, 1) AS shares FROM si_annual a LEFT JOIN (SELECT ticker, product(ratio) AS f FROM si_splits WHERE {cond} GROUP BY ticker) s ON a.ticker = s.ticker"


@query("spl5_apply_later_splits", _fig_sql(f"{_SPLIT} AND date > DATE '1997-03-01' AND date <= DATE '2001-06-01'", "/", "*"), r="eps shares")
def spl5(u):
    return sp.apply_later_splits(_figs(u, "2001-06-01", "1997-03-01"), u.splits).select("ticker", "fiscal_year", "eps", "shares")


@query("spl5_undo_splits", _fig_sql(f"{_REST} AND date > DATE '1998-06-01' AND date <= DATE '2000-03-01'", "*", "/"), r="eps shares")
def spl5u(u):
    return sp.undo_splits_after_price(_figs(u, "1998-06-01", "2000-03-01"), u.splits).select("ticker", "fiscal_year", "eps", "shares")


@query("spl6_ads_ratio", "SELECT ticker, date, r, CASE WHEN r BETWEEN 0.8 AND 1.25 THEN 1 WHEN round(r) >= 2 AND abs(r - round(r)) <= least(0.05 * round(r), 0.25) THEN round(r) WHEN round(1 / r) >= 2 AND abs(1 / r - round(1 / r)) <= least(0.05 * round(1 / r), 0.25) THEN 1 / round(1 / r) END AS ads FROM (SELECT ticker, date, close / 20 AS r FROM si_bars) x", r="r:9 ads")
def spl6(u):
    return u.bars.select("ticker", "date", (F.col("close") / 20).alias("r")).withColumn("ads", sp.ads_ratio(F.col("r")))


@query("spl7_dividends_onto", "SELECT d.ticker, d.date, d.amount * coalesce(product(CASE WHEN s.date > DATE '1998-01-01' THEN ratio ELSE 1 / ratio END), 1) AS amount FROM (SELECT *, CASE WHEN payments = 1 THEN date + 100 END AS served_on FROM si_dividends) d LEFT JOIN si_splits s ON s.ticker = d.ticker AND ((s.date > DATE '1998-01-01' AND (served_on IS NULL OR s.date <= served_on)) OR (s.date > served_on AND s.date <= DATE '1998-01-01')) GROUP BY d.ticker, d.date, d.amount", r="amount")
def spl7(u):
    d = u.dividends.withColumn("served_on", F.when(F.col("payments") == 1, F.date_add("date", 100)))
    return sp.dividends_onto(d, u.splits, F.lit("1998-01-01").cast("date")).select("ticker", "date", "amount")


_DAYS = "SELECT ticker, date, CASE WHEN amount > 0.9 THEN 1.2 ELSE 2.0 END AS ratio FROM si_dividends"


@query("spl8_drop_spin_offs", f"SELECT d.ticker, d.date, d.amount FROM si_dividends d WHERE NOT coalesce(d.amount > 0.9 AND d.amount > 5 * (SELECT median(o.amount) FROM si_dividends o WHERE o.ticker = d.ticker AND o.date <> d.date AND abs(date_diff('day', o.date, d.date)) <= 400), false)")
def spl8(u):
    days = u.dividends.select("ticker", "date", F.when(F.col("amount") > 0.9, 1.2).otherwise(2.0).alias("ratio"))
    return sp.drop_spin_offs(u.dividends.select("ticker", "date", "amount"), days)


@query("spl9_dividend_factors", """WITH RECURSIVE p AS (SELECT d.ticker, d.date, d.amount, row_number() OVER (PARTITION BY d.ticker ORDER BY d.date DESC) AS k, c.close FROM si_dividends d JOIN (SELECT d.ticker, d.date, arg_max(b.close, b.date) AS close FROM si_dividends d JOIN si_bars b ON b.ticker = d.ticker AND b.date < d.date GROUP BY ALL) c ON c.ticker = d.ticker AND c.date = d.date),
 f AS (SELECT ticker, date, amount, k, 1 / (1 + amount / close) AS factor, 1 / (1 + amount / close) AS later FROM p WHERE k = 1 UNION ALL SELECT p.ticker, p.date, p.amount, p.k, 1 / (1 + p.amount * f.later / p.close), f.later / (1 + p.amount * f.later / p.close) FROM p JOIN f ON p.ticker = f.ticker AND p.k = f.k + 1)
SELECT ticker, date, amount, factor FROM f""", r="factor")
def spl9(u):
    return sp.dividend_factors(u.dividends.select("ticker", "date", "amount"), u.bars)


@query("spl10_bars_to_price", "SELECT b.ticker, CASE WHEN last > DATE '1999-06-30' THEN coalesce(product(ratio), 1) ELSE 1 / coalesce(product(ratio), 1) END AS factor FROM (SELECT ticker, max(date) AS last FROM si_bars GROUP BY ticker) b LEFT JOIN si_splits s ON s.ticker = b.ticker AND s.date > least(last, DATE '1999-06-30') AND s.date <= greatest(last, DATE '1999-06-30') GROUP BY b.ticker, last", r="factor")
def spl10(u):
    snap = u.snapshots.withColumn("collected_at", F.lit("1999-06-30").cast("timestamp"))
    return sp.bars_to_price(u.splits, snap, u.bars)


@query("spl11_total_shares", "SELECT ticker, at_time, CASE WHEN short THEN 120000 WHEN wide THEN cap / price ELSE vendor END AS shares, CASE WHEN short THEN 'financials_annual' WHEN wide THEN 'market_cap / price' ELSE 'market_snapshot' END AS source FROM (SELECT *, coalesce(CASE WHEN wide THEN cap / price ELSE vendor END < 0.75 * 120000, false) AS short FROM (SELECT *, vendor IS NULL OR cap / price > 1.02 * vendor AS wide FROM (SELECT ticker, collected_at AS at_time, market_cap AS cap, current_price * (0.6 + 0.3 * coalesce(beta, 1)) AS price, CASE WHEN previous_close > 30 THEN shares_outstanding END AS vendor FROM si_snapshots) a) b) c", r="shares")
def spl11(u):
    price = F.col("current_price") * (0.6 + 0.3 * F.coalesce("beta", F.lit(1.0)))
    n, s = sp.total_shares(F.col("market_cap"), price, F.when(F.col("previous_close") > 30, F.col("shares_outstanding")), F.lit(120000.0))
    return u.snapshots.select("ticker", F.col("collected_at").alias("at_time"), n.alias("shares"), s.alias("source"))


@query("spl13_pick_share_field", "SELECT ticker, CASE WHEN a >= 0.6 THEN 'shares_outstanding' WHEN b >= 0.6 THEN 'weighted_avg_shares_diluted' WHEN c >= 0.6 THEN 'net_income/eps_diluted' END AS share_field FROM (SELECT ticker, avg((capex > 100000)::INT) AS a, avg((net_income > 60000)::INT) AS b, avg((abs(eps_diluted) >= 0.1)::INT) AS c FROM (SELECT *, coalesce(capex, 0) AS capex FROM (SELECT * EXCLUDE (capex), coalesce(capex, 0) AS capex FROM si_quarterly) z) y GROUP BY ticker) x")
def spl13(u):
    q = u.quarterly.withColumns({"shares_outstanding": F.when(F.col("capex") > 100000, F.col("shares_outstanding")),
                                 "weighted_avg_shares_diluted": F.when(F.col("net_income") > 60000, F.col("weighted_avg_shares_diluted"))})
    return sp.pick_share_field(q)


@query("spl15_factors_since", f"SELECT s.ticker, s.date, s.ratio, {_SPLIT} AS share_split FROM si_splits s WHERE s.date > DATE '2000-01-01' OR s.date > DATE '1999-10-01'")
def spl15(u):
    snap = u.snapshots.withColumn("collected_at", F.lit("2000-01-01").cast("timestamp"))
    runs = u.company.select("ticker", F.lit("1999-10-01").cast("timestamp").alias("collected_at"))
    return sp.factors_since(u.splits, snap, runs)


# ---- insiders: a user's day is a filing; a sign-up that day makes it an amendment of the user's day before.

AS_OF = "2024-01-31"
WINDOWS = (("3d", 3), ("10d", 10), ("30d", 30))
R["si_form_trades"] = """
SELECT concat('F', CAST(user_id AS VARCHAR(12)), '-', CAST(CAST(ts AS DATE) AS VARCHAR(10))) AS accession,
  CAST(row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) AS INT) AS seq, concat('S', CAST(user_id % 20 AS VARCHAR(4))) AS ticker,
  CAST(user_id AS BIGINT) AS owner_cik, 'nonderivative' AS kind, 'Common  Stock' AS security_title, CAST(ts AS DATE) AS filed_date, CAST(date_trunc('week', ts) AS DATE) AS date,
  CASE event_type WHEN 'purchase' THEN 'P' WHEN 'error' THEN 'S' ELSE 'M' END AS code, CAST(floor(value / 20) AS DOUBLE) AS shares, CAST(floor(value / 10) AS DOUBLE) AS price, event_type
FROM events
"""
R["si_form_filings"] = """
SELECT accession, ticker, owner_cik, filed_date, form, period_of_report, CASE WHEN form = '4/A' THEN lag(filed_date) OVER (PARTITION BY owner_cik ORDER BY filed_date) END AS original_filed,
  owner_cik % 20 < 3 AS is_ceo_cfo, CASE WHEN owner_cik % 3 = 0 THEN 'Chief Executive Officer' END AS officer_title, owner_cik % 2 = 0 AS is_director, owner_cik % 7 = 0 AS is_ten_percent
FROM (SELECT accession, ticker, owner_cik, filed_date, CASE WHEN max(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) = 1 THEN '4/A' ELSE '4' END AS form, min(date) AS period_of_report
      FROM si_form_trades GROUP BY accession, ticker, owner_cik, filed_date) f
"""


def as_of():
    return F.lit(AS_OF).cast("date")


@query("ins1_form4_refs", "SELECT ticker, accession, form, filed_date AS filed, period_of_report FROM si_form_filings WHERE filed_date >= DATE '2024-01-10' AND is_director")
def ins1(u):
    f = u.form_filings
    pages = f.groupBy("ticker").agg(*[F.collect_list(c).alias(n) for c, n in (("accession", "accessionNumber"), ("form", "form"))],
        F.collect_list(F.col("filed_date").cast("string")).alias("filingDate"), F.collect_list(F.col("period_of_report").cast("string")).alias("reportDate"),
        F.collect_list(F.when(F.col("is_director"), F.lit("form4.xml")).otherwise(F.lit(""))).alias("primaryDocument"))
    return ins.form4_refs(pages, F.lit("2024-01-10").cast("date")).drop("primaryDocument")


@query("ins2_company_filings", "WITH own AS (SELECT ticker, accession, filed_date AS filed FROM si_form_filings WHERE owner_cik >= 20) SELECT * FROM own UNION ALL SELECT o.ticker, o.accession, o.filed_date FROM si_form_filings o LEFT JOIN (SELECT ticker, min(filed) AS f FROM own GROUP BY ticker) x ON x.ticker = o.ticker WHERE owner_cik < 20 AND (f IS NULL OR o.filed_date < f)")
def ins2(u):
    f = u.form_filings.select("accession", F.concat(F.col("ticker"), F.when(F.col("owner_cik") < 20, "old").otherwise("new")).alias("issuer_cik"), F.col("filed_date").alias("filed"))
    t = u.form_filings.select("ticker").distinct()
    return ins.company_filings(f, t.withColumn("cik", F.concat("ticker", F.lit("new"))), t.withColumn("predecessor_cik", F.concat("ticker", F.lit("old")))).select("ticker", "accession", "filed")


@query("ins4_price_suspect", "SELECT t.accession, t.price, b.close, CASE WHEN b.close <> 0 THEN abs(t.price / 1000 - b.close) <= 0.1 * b.close OR abs(t.price * 1000 - b.close) <= 0.1 * b.close END AS price_suspect FROM (SELECT accession, ticker, date, price * 40 AS price FROM si_trades) t ASOF LEFT JOIN (SELECT ticker, CAST(date + INTERVAL 28 YEAR AS DATE) AS date, close / 100 AS close FROM si_bars) b ON b.ticker = t.ticker AND t.date >= b.date", r="price:9 close:9")
def ins4(u):
    bars = u.bars.select("ticker", F.add_months("date", 12 * 28).alias("date"), (F.col("close") / 100).alias("close"))
    return ins.price_suspect(u.trades.withColumn("price", F.col("price") * 40), bars).select("accession", "price", "close", "price_suspect")


_AMEND = "SELECT a.accession, arg_max(e.accession, CASE WHEN e.period_of_report = a.period_of_report THEN '1' ELSE '0' END || CAST(e.filed_date AS VARCHAR) || (CASE WHEN e.form = '4/A' THEN '1' ELSE '0' END) || e.accession) AS amends FROM si_form_filings a JOIN si_form_filings e ON a.ticker = e.ticker AND a.owner_cik = e.owner_cik AND e.filed_date = a.original_filed WHERE a.form = '4/A' GROUP BY a.accession"


@query("ins5_amended_by", _AMEND)
def ins5(u):
    return ins.amended_by(u.form_filings)


@query("ins5_amendment_chains", f"WITH RECURSIVE e AS ({_AMEND}), c AS (SELECT accession, amends AS root FROM e UNION ALL SELECT c.accession, e.amends FROM c JOIN e ON c.root = e.accession) SELECT accession, root FROM c WHERE root NOT IN (SELECT accession FROM e) UNION SELECT root, root FROM c WHERE root NOT IN (SELECT accession FROM e)")
def ins5c(u):
    return ins.amendment_chains(u.form_filings)


_KEYS6 = ("title, code, date, shares, price", "title, date, shares, price", "title, code, shares, price", "title, code, date")


def _restated_sql(ranks: int) -> str:
    """Each amendment and pass as a step that pairs what the steps before left, by number within chain and key."""
    parts = [f"am AS ({_AMEND})", "c AS (SELECT accession, amends AS root FROM am UNION ALL SELECT c.accession, am.amends FROM c JOIN am ON c.root = am.accession)",
             "chain AS (SELECT accession, root FROM c WHERE root NOT IN (SELECT accession FROM am) UNION SELECT root, root FROM c WHERE root NOT IN (SELECT accession FROM am))",
             "ranked AS (SELECT root, accession, row_number() OVER (PARTITION BY root ORDER BY filed_date, form = '4/A', accession) AS r FROM chain JOIN (SELECT DISTINCT accession, filed_date, form FROM si_form_filings) f USING (accession))",
             "t AS MATERIALIZED (SELECT root, r, accession, seq, code, date, shares, price, lower(regexp_replace(trim(security_title), '\\s+', ' ', 'g')) AS title FROM si_form_trades JOIN ranked USING (accession))",
             "done0 AS (SELECT accession, seq, accession AS restated_by, accession AS by_acc, seq AS by_seq FROM t WHERE false)"]
    n = 0
    for r in range(2, ranks + 1):
        for k in _KEYS6:
            num = f"row_number() OVER (PARTITION BY root, {k} ORDER BY r, seq) AS turn"
            parts.append(f"""done{n + 1} AS MATERIALIZED (SELECT * FROM done{n} UNION ALL SELECT o.accession, o.seq, m.accession, m.accession, m.seq FROM
 (SELECT *, {num} FROM t WHERE r < {r} AND (accession, seq) NOT IN (SELECT (accession, seq) FROM done{n})) o JOIN
 (SELECT *, {num} FROM t WHERE r = {r} AND (accession, seq) NOT IN (SELECT (by_acc, by_seq) FROM done{n})) m USING (root, {k}, turn))""")
            n += 1
    return "WITH RECURSIVE " + ", ".join(parts) + f" SELECT accession, CAST(seq AS BIGINT) AS seq, restated_by FROM done{n}"


@query("ins6_restated_trades", _restated_sql(8))
def ins6(u):
    return ins.restated_trades(u.form_filings, u.form_trades)


@query("ins7_filing_buyer", "SELECT accession, owner_cik FROM (SELECT accession, owner_cik, row_number() OVER (PARTITION BY accession ORDER BY chief DESC, owner_cik) AS k FROM (SELECT ticker || CAST(filed_date AS VARCHAR) AS accession, owner_cik, is_ceo_cfo AS chief FROM si_form_filings) a) b WHERE k = 1")
def ins7(u):
    f = u.form_filings.withColumn("accession", F.concat("ticker", F.col("filed_date").cast("string")))
    return ins.filing_buyer(f).select("accession", "owner_cik")


def _tot(label, days):
    w = f"date >= DATE '{AS_OF}' - {days}"
    out = []
    for n, code in (("bought", "P"), ("sold", "S")):
        out.append(f"coalesce(sum(shares) FILTER (code = '{code}' AND {w}), 0) AS {n}_shares_{label}, coalesce(sum(shares * price) FILTER (code = '{code}' AND {w}), 0) AS {n}_value_{label}")
    return ", ".join(out) + f", coalesce(sum(shares * price) FILTER (code = 'P' AND {w}), 0) - coalesce(sum(shares * price) FILTER (code = 'S' AND {w}), 0) AS net_value_{label}, count(DISTINCT owner_cik) FILTER (code = 'P' AND {w}) AS buyers_{label}, count(DISTINCT owner_cik) FILTER (code = 'S' AND {w}) AS sellers_{label}"


@query("ins8_window_totals", "SELECT ticker, " + ", ".join(_tot(*w) for w in WINDOWS) + " FROM si_trades WHERE code IN ('P', 'S') GROUP BY ticker", r=" ".join(f"{n}_value_{w}" for n in ("bought", "sold", "net") for w, _ in WINDOWS))
def ins8(u):
    return ins.window_totals(u.trades, as_of(), WINDOWS)


@query("ins9_chief_buys", f"SELECT ticker, accession, min(date) AS date, max(date) AS last_date, sum(shares) AS shares, sum(shares * price) AS value FROM si_trades WHERE code = 'P' AND is_ceo_cfo AND date >= DATE '{AS_OF}' - 365 GROUP BY ALL", r="value")
def ins9(u):
    return ins.chief_buys(u.trades, as_of())


R["ox_ahead"] = "SELECT s.ticker, s.date AS start, count(DISTINCT t.owner_cik) AS buyers, max(t.date) AS \"end\", sum(t.shares) AS shares, sum(t.shares * t.price) AS value FROM (SELECT DISTINCT ticker, date FROM si_trades WHERE code = 'P') s JOIN si_trades t ON t.ticker = s.ticker AND t.code = 'P' AND t.date BETWEEN s.date AND s.date + 2 GROUP BY ALL"


@query("ins10_clusters", """WITH RECURSIVE q AS (SELECT * FROM ox_ahead WHERE buyers >= 7), c(ticker, start) AS (SELECT ticker, min(start) FROM q GROUP BY ticker UNION ALL SELECT c.ticker, (SELECT min(q.start) FROM q WHERE q.ticker = c.ticker AND q.start > c.start + 2) FROM c WHERE c.start IS NOT NULL)
SELECT q.ticker, q.start, q."end", q.buyers, q.shares, q.value FROM c JOIN q ON q.ticker = c.ticker AND q.start = c.start""", r="value")
def ins10(u):
    return ins.clusters(u.trades, 2, 7)


@query("ins10_largest_cluster", "SELECT ticker, max(buyers) AS largest_cluster FROM ox_ahead GROUP BY ticker")
def ins10l(u):
    return ins.largest_cluster(u.trades, 2)


@query("ins11_planned_sale_share", f"SELECT ticker, coalesce(sum(shares) FILTER (aff10b5one), 0) / sum(shares) AS planned_sale_share FROM si_trades WHERE code = 'S' AND date >= DATE '{AS_OF}' - 365 GROUP BY ticker", r="planned_sale_share")
def ins11(u):
    return ins.planned_sale_share(u.trades, as_of())


@query("ins12_insider_view", """SELECT t.ticker, t.date, t.accession, CAST(f.owner_cik AS VARCHAR) AS owner, coalesce(nullif(concat_ws(', ', coalesce(officer_title, CASE WHEN is_director THEN 'Director' END), CASE WHEN is_ten_percent THEN '10% owner' END), ''), '—') AS role, code,
 CASE code WHEN 'P' THEN 'open-market purchase' WHEN 'S' THEN 'open-market sale' ELSE 'option exercise' END AS meaning, shares, price, shares * price AS value, 'filing' AS source FROM si_form_trades t JOIN si_form_filings f ON t.accession = f.accession WHERE t.ticker <> 'S3'
UNION ALL SELECT ticker, date, NULL, 'v', '—', 'P', 'open-market purchase', volume, close, volume * close, 'vendor' FROM si_bars WHERE ticker NOT IN (SELECT ticker FROM si_form_trades WHERE ticker <> 'S3')""", r="value price")
def ins12(u):
    trades = u.form_trades.where(F.col("ticker") != "S3").drop("filed_date")
    vendor = u.bars.select("ticker", "date", F.lit("v").alias("owner"), F.lit("P").alias("code"), F.col("volume").alias("shares"), F.col("close").alias("price"))
    return ins.insider_view(trades, ins.filing_buyer(u.form_filings), vendor)


# ---- funds: an urgent order amends its manager's quarterly report with new holdings, a low-priority one restates it.

R["si_fund_lines"] = """
SELECT CAST(o_custkey % 40 AS BIGINT) AS manager, CAST(o_custkey % 80 AS BIGINT) AS filer,
  CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS period,
  CASE WHEN o_orderpriority LIKE '1%' THEN 'N' WHEN o_orderpriority LIKE '5%' THEN 'R' ELSE 'B' END AS part,
  concat(CAST(o_custkey % 80 AS VARCHAR(8)), '-', CAST(CAST(date_trunc('quarter', o_orderdate) AS DATE) AS VARCHAR(10)), '-',
         CASE WHEN o_orderpriority LIKE '1%' THEN 'N' WHEN o_orderpriority LIKE '5%' THEN 'R' ELSE 'B' END) AS accession,
  CAST(l_orderkey * 1000000 + l_linenumber * 100000 + CAST(floor(l_extendedprice) AS BIGINT) % 100000 AS BIGINT) AS row,
  concat('C', CAST(100 + l_partkey % 40 AS VARCHAR(6)), 'XX', CAST(l_partkey % 3 AS VARCHAR(1)), CAST(l_partkey % 200 AS VARCHAR(4))) AS cusip,
  concat('Issuer ', CAST(l_suppkey % 7 AS VARCHAR(2))) AS issuer, 'COM' AS title_of_class, CASE WHEN l_returnflag = 'A' THEN 'PRN' ELSE 'SH' END AS share_type,
  CASE WHEN l_returnflag = 'R' AND l_quantity <= 10 THEN 'Put' END AS put_call, CAST(floor(l_quantity / 10) AS DOUBLE) * 10 + 10 AS shares,
  CAST(floor(l_extendedprice / 20000) AS DOUBLE) * 20000 + 20000 AS value
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""
R["si_fund_filings"] = """
SELECT manager, filer, period, accession, CASE part WHEN 'B' THEN '13F-HR' ELSE '13F-HR/A' END AS form, CASE part WHEN 'N' THEN 'NEW HOLDINGS' WHEN 'R' THEN 'RESTATEMENT' END AS amendment_type,
  CAST(CASE part WHEN 'B' THEN period + INTERVAL 40 DAY WHEN 'R' THEN period + INTERVAL 50 DAY ELSE period + INTERVAL 70 DAY END AS DATE) AS filed, CAST(count(*) AS BIGINT) AS entry_total,
  sum(value) + CASE WHEN sum(shares) % 7 = 0 THEN 1000000 ELSE 0 END AS value_total, CASE WHEN count(*) % 3 = 0 THEN NULL ELSE count(*) % 3 = 1 END AS confidential_omitted
FROM si_fund_lines GROUP BY manager, filer, period, part, accession
"""
R["si_fund_cusips"] = "SELECT cusip, concat('T', substr(cusip, 5, 3), substr(cusip, 2, 3)) AS ticker FROM si_fund_lines WHERE substr(cusip, 2, 3) < '120' GROUP BY cusip"
R["si_fund_splits"] = "SELECT concat('T', substr(cusip, 5, 3), substr(cusip, 2, 3)) AS ticker, CAST(period + INTERVAL 30 DAY AS DATE) AS date, CAST(CASE WHEN sum(shares) % 20 = 0 THEN 2.0 ELSE 1.061 END AS DOUBLE) AS ratio FROM si_fund_lines WHERE put_call = 'Put' AND value >= 80000 GROUP BY cusip, period"


def filings(u):
    return u.shared("fund_filings_checked", lambda: u.fund_filings.join(g.checksum(u.fund_filings, u.fund_lines), "accession"))


def holdings(u):
    return u.fund_lines.select("accession", "row", "cusip", "issuer", "title_of_class", "share_type", "put_call", "shares", F.col("value").alias("value_usd"))


def standing(u):
    return u.shared("fund_standing", lambda: g.standing_filings(filings(u)))


def positions(u):
    return u.shared("fund_positions", lambda: g.positions(g.drop_repeated_rows(holdings(u), standing(u)), u.fund_cusips))


def quarters(u):
    def build():
        c = g.quarter_complete(filings(u), standing(u))
        t = positions(u).groupBy("manager", "period").agg(F.sum("value").alias("total_value"))
        f = standing(u).groupBy("manager", "period").agg(F.max("filed").alias("filed"))
        return c.join(t, ["manager", "period"], "left").join(f, ["manager", "period"], "left")
    return u.shared("fund_quarters", build)


def pairs(u):
    return u.shared("fund_pairs", lambda: g.with_previous(positions(u), quarters(u)))


def covered(u):
    return u.fund_splits.select("ticker").distinct()


def implied(u):
    return u.shared("fund_implied", lambda: g.implied_splits(pairs(u), covered(u)))


def changes(u):
    return u.shared("fund_changes", lambda: g.quarter_changes(pairs(u), u.fund_splits, implied(u)))


R["ox_ff"] = "SELECT f.*, entry_total = n AND abs(v - value_total) <= (entry_total + 1) / 2 AS checksum_ok, coalesce(amendment_type, '') = 'NEW HOLDINGS' AS adds, CAST(filed AS VARCHAR) || accession AS o FROM si_fund_filings f JOIN (SELECT accession, count(*) AS n, sum(value) AS v FROM si_fund_lines GROUP BY 1) l USING (accession)"
R["ox_fs"] = "SELECT f.manager, f.filer, f.period, f.accession, f.filed, CASE WHEN adds THEN (SELECT accession FROM ox_ff z WHERE z.filer = f.filer AND z.period = f.period AND z.o = b) END AS base_accession FROM ox_ff f JOIN (SELECT filer, period, max(o) FILTER (NOT adds) AS b FROM ox_ff WHERE checksum_ok GROUP BY ALL) x ON x.filer = f.filer AND x.period = f.period WHERE checksum_ok AND b IS NOT NULL AND (o = b OR (adds AND o > b))"
R["ox_fr"] = """SELECT r.* FROM (SELECT l.*, s.base_accession, s.filed, row_number() OVER (PARTITION BY l.accession, cusip, put_call, shares, value ORDER BY row) AS k FROM si_fund_lines l JOIN ox_fs s ON s.accession = l.accession) r
LEFT JOIN (SELECT accession, cusip, put_call, shares, value, count(*) AS n FROM si_fund_lines GROUP BY ALL) b ON b.accession = r.base_accession AND b.cusip = r.cusip AND b.put_call IS NOT DISTINCT FROM r.put_call AND b.shares = r.shares AND b.value = r.value
WHERE r.base_accession IS NULL OR n IS NULL OR k > n"""
R["ox_fp"] = """SELECT manager, period, security, put_call, max(ticker) AS ticker, arg_min(issuer, CAST(filed AS VARCHAR) || accession || lpad(CAST(row AS VARCHAR), 20, '0')) AS issuer, arg_min(share_type, CAST(filed AS VARCHAR) || accession || lpad(CAST(row AS VARCHAR), 20, '0')) AS share_type, count(DISTINCT cusip) AS n_cusips, sum(shares) AS shares, sum(value) AS value, sum(value) / sum(sum(value)) OVER (PARTITION BY manager, period) AS weight
FROM (SELECT r.* EXCLUDE (put_call), coalesce(c.ticker, r.cusip) AS security, c.ticker, coalesce(r.put_call, '') AS put_call FROM ox_fr r LEFT JOIN si_fund_cusips c ON c.cusip = r.cusip) x GROUP BY manager, period, security, put_call"""
_NEXTQ = "CAST(CAST(period + 1 AS DATE) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE)"
R["ox_fq"] = f"""SELECT f.manager, f.period, bool_and(st) AND (NOT coalesce(any_value(aw), false) OR (SELECT max(filed) FROM si_fund_filings) > f.period + 48) AS complete
FROM (SELECT DISTINCT a.manager, a.filer, a.period, EXISTS (SELECT 1 FROM ox_fs s WHERE s.filer = a.filer AND s.period = a.period) AS st FROM si_fund_filings a) f
LEFT JOIN (SELECT DISTINCT manager, {_NEXTQ} AS period, true AS aw FROM si_fund_filings p WHERE NOT EXISTS (SELECT 1 FROM si_fund_filings n WHERE n.filer = p.filer AND n.period = CAST(CAST(p.period + 1 AS DATE) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE))) w ON w.manager = f.manager AND w.period = f.period GROUP BY f.manager, f.period"""
R["ox_fpair"] = f"""SELECT coalesce(n.manager, b.manager) AS manager, coalesce(n.period, b.period) AS period, coalesce(n.security, b.security) AS security, coalesce(n.put_call, b.put_call) AS put_call, coalesce(n.ticker, b.ticker) AS ticker, coalesce(n.issuer, b.issuer) AS issuer, coalesce(n.share_type, b.share_type) AS share_type,
 b.shares AS shares_before, n.shares AS shares_after, b.value AS value_before, n.value AS value_after FROM (SELECT * FROM ox_fp WHERE (manager, period) IN (SELECT (manager, period) FROM ox_fok)) n FULL JOIN (SELECT * REPLACE ({_NEXTQ} AS period) FROM ox_fp WHERE (manager, {_NEXTQ}) IN (SELECT (manager, period) FROM ox_fok)) b
 ON n.manager = b.manager AND n.period = b.period AND n.security = b.security AND n.put_call = b.put_call"""
R["ox_fok"] = f"SELECT a.manager, a.period FROM ox_fq a JOIN (SELECT manager, {_NEXTQ} AS period FROM ox_fq WHERE complete) b ON a.manager = b.manager AND a.period = b.period WHERE a.complete"
_RAT = "[" + ", ".join(map(str, g.SPLIT_RATIOS)) + "]"
R["ox_fi"] = f"""SELECT security, period, CAST(arg_min(r, gap) AS DOUBLE) AS implied FROM (SELECT m.security, m.period, r, abs(ln(price / r)) AS gap FROM (SELECT *, list_sort([{{'g': abs(ln(m / x)), 'r': x}} FOR x IN {_RAT}])[1].r AS r FROM ox_fm) m
 JOIN (SELECT security, period, median(p) AS price, bool_or(abs(m - 1) <= 0.05) AS veto FROM ox_fm GROUP BY ALL) v ON v.security = m.security AND v.period = m.period WHERE NOT veto AND abs(m / r - 1) <= 0.05 AND greatest(price / r, r / price) <= 1.3) x GROUP BY ALL"""
R["ox_fm"] = "SELECT security, period, shares_after / shares_before AS m, (value_before / shares_before) / (value_after / shares_after) AS p FROM ox_fpair WHERE put_call = '' AND share_type = 'SH' AND shares_before > 0 AND shares_after > 0 AND value_before > 0 AND value_after > 0 AND (ticker IS NULL OR ticker NOT IN (SELECT ticker FROM si_fund_splits))"
R["ox_fc"] = f"""SELECT *, CASE WHEN shares_before IS NULL THEN 'new' WHEN shares_after IS NULL THEN 'sold_out' WHEN shares_after > shares_before * split_factor THEN 'added' WHEN shares_after < shares_before * split_factor THEN 'reduced' ELSE 'unchanged' END AS action,
 CASE WHEN shares_before IS NOT NULL AND shares_after IS NOT NULL THEN (shares_after - shares_before * split_factor) / (shares_before * split_factor) END AS change_pct FROM (
SELECT p.*, CASE WHEN shares_before IS NULL THEN 1 ELSE coalesce((SELECT product(ratio) FROM si_fund_splits s WHERE s.ticker = p.ticker AND ratio = 2 AND s.date <= p.period AND s.date > CAST(date_trunc('quarter', p.period) AS DATE) - 1), 1) * coalesce(i.implied, 1) END AS split_factor
FROM ox_fpair p LEFT JOIN ox_fi i ON i.security = p.security AND i.period = p.period) x"""


@query("gur1_filing_refs", "SELECT accession, period, CAST(period + 48 AS DATE) AS deadline FROM si_fund_filings WHERE period >= CAST(date_trunc('quarter', DATE '1999-08-15') - INTERVAL 6 MONTH AS DATE)")
def gur1(u):
    start = g.quarter_start(F.lit("1999-08-15").cast("date"), 2)
    return g.filing_refs(u.fund_filings, start).select("accession", "period", g.filing_deadline(F.col("period")).alias("deadline"))


@query("gur2_unit_multiplier", "SELECT f.accession, CAST(CASE WHEN md < 1 AND md * 1000 BETWEEN 1 AND 100000 THEN 1000.0 WHEN md > 100000 AND md / 1000 BETWEEN 1 AND 100000 THEN 1.0 ELSE d END AS DOUBLE) AS multiplier FROM (SELECT accession, CASE WHEN filed + INTERVAL 24 YEAR < DATE '2023-01-03' THEN 1000.0 ELSE 1.0 END AS d FROM si_fund_filings) f LEFT JOIN (SELECT accession, median(value / shares) AS m FROM si_fund_lines WHERE share_type = 'SH' GROUP BY 1) p ON p.accession = f.accession, LATERAL (SELECT m * d AS md) z")
def gur2(u):
    return g.unit_multiplier(u.fund_filings.withColumn("filed", F.add_months("filed", 288)), u.fund_lines)


@query("gur3_checksum", "SELECT accession, checksum_ok FROM ox_ff")
def gur3(u):
    return g.checksum(u.fund_filings, u.fund_lines)


@query("gur4_standing_filings", "SELECT * FROM ox_fs")
def gur4(u):
    return standing(u)


@query("gur5_drop_repeated_rows", "SELECT accession, cusip, put_call, shares, value AS value_usd, count(*) AS n FROM ox_fr GROUP BY ALL")
def gur5(u):
    return g.drop_repeated_rows(holdings(u), standing(u)).groupBy("accession", "cusip", "put_call", "shares", "value_usd").agg(F.count("*").alias("n"))


@query("gur6_positions", "SELECT manager, period, security, put_call, ticker, shares, value, weight, CAST(n_cusips AS INT) AS n_cusips FROM ox_fp", r="weight")
def gur6(u):
    return positions(u).select("manager", "period", "security", "put_call", "ticker", "shares", "value", "weight", F.size("cusips").alias("n_cusips"))


@query("gur7_quarter_complete", "SELECT * FROM ox_fq")
def gur7(u):
    return g.quarter_complete(filings(u), standing(u))


@query("gur8_implied_splits", "SELECT * FROM ox_fi")
def gur8(u):
    return implied(u)


@query("gur9_quarter_changes", "SELECT manager, period, security, put_call, shares_before, shares_after, value_before, value_after, split_factor, action, change_pct FROM ox_fc", r="split_factor change_pct")
def gur9(u):
    return changes(u).select("manager", "period", "security", "put_call", "shares_before", "shares_after", "value_before", "value_after", "split_factor", "action", "change_pct")


@query("gur10_build_quarters", "SELECT q.manager, q.period, complete, (SELECT sum(value) FROM ox_fp p WHERE p.manager = q.manager AND p.period = q.period) AS total_value, (SELECT max(filed) FROM ox_fs s WHERE s.manager = q.manager AND s.period = q.period) AS filed, (q.manager, q.period) IN (SELECT (manager, period) FROM ox_fok) AS has_prior FROM ox_fq q")
def gur10(u):
    return g.build_quarters(filings(u), holdings(u), u.fund_cusips, u.fund_splits, covered(u))[0].select("manager", "period", "complete", "total_value", "filed", "has_prior")


R["si_fund_listings"] = "SELECT cusip, concat('L/', substr(cusip, 2, 6)) AS ticker, issuer AS name, CASE substr(issuer, 8, 1) WHEN '0' THEN 'US' WHEN '1' THEN 'UN' ELSE 'GY' END AS exch_code, min(row) AS position FROM si_fund_lines WHERE substr(cusip, 2, 3) >= '115' AND substr(cusip, 2, 3) < '130' GROUP BY cusip, issuer"


@query("gur11_map_cusips", """SELECT c.cusip, CASE WHEN u.ticker IS NOT NULL THEN u.ticker WHEN f.tier < 2 THEN replace(f.ticker, '/', '-') END AS ticker, CASE WHEN u.ticker IS NULL AND f.cusip IS NOT NULL THEN f.name ELSE c.issuer END AS name, CASE WHEN u.ticker IS NOT NULL THEN 'universe' WHEN f.cusip IS NOT NULL THEN 'openfigi' ELSE 'none' END AS source
FROM (SELECT cusip, issuer FROM (SELECT cusip, issuer, row_number() OVER (PARTITION BY cusip ORDER BY n DESC, issuer) AS k FROM (SELECT cusip, issuer, count(*) AS n FROM si_fund_lines GROUP BY ALL) a) b WHERE k = 1) c LEFT JOIN si_fund_cusips u ON u.cusip = c.cusip
LEFT JOIN (SELECT * FROM (SELECT *, CASE exch_code WHEN 'US' THEN 0 WHEN 'UN' THEN 1 ELSE 2 END AS tier FROM si_fund_listings) QUALIFY row_number() OVER (PARTITION BY cusip ORDER BY tier, position) = 1) f ON f.cusip = c.cusip""")
def gur11(u):
    return g.map_cusips(u.fund_lines, u.fund_cusips, u.fund_listings)


@query("gur12_share_classes", "SELECT DISTINCT a.ticker, b.ticker AS class_ticker FROM si_fund_cusips a JOIN si_fund_cusips b ON substr(a.cusip, 1, 6) = substr(b.cusip, 1, 6)")
def gur12(u):
    return g.share_classes(u.fund_cusips)


R["ox_fl"] = "SELECT l.manager, l.period, q.complete FROM (SELECT manager, coalesce(max(period) FILTER (complete), max(period)) AS period FROM ox_fq GROUP BY manager) l JOIN ox_fq q USING (manager, period)"


@query("gur13_latest_quarters", f"SELECT manager, period, complete, {_NEXTQ} + 48 >= (SELECT max(filed) FROM ox_fs) AS current FROM ox_fl")
def gur13(u):
    return g.latest_quarters(quarters(u))


@query("gur14_guru_list", """SELECT l.manager, l.period, l.complete, (SELECT count(*) FROM ox_fp p WHERE p.manager = l.manager AND p.period = l.period AND put_call = '') AS positions,
 CASE WHEN hp THEN (SELECT count(*) FROM ox_fc p WHERE p.manager = l.manager AND p.period = l.period AND put_call = '' AND action = 'new') END AS new, CASE WHEN hp THEN (SELECT count(*) FROM ox_fc p WHERE p.manager = l.manager AND p.period = l.period AND put_call = '' AND action = 'sold_out') END AS sold_out
FROM (SELECT l.*, (l.manager, l.period) IN (SELECT (manager, period) FROM ox_fok) AS hp FROM ox_fl l) l""")
def gur14(u):
    prior = pairs(u).select("manager", "period").distinct().withColumn("has_prior", F.lit(True))
    q = quarters(u).join(prior, ["manager", "period"], "left").withColumn("has_prior", F.coalesce("has_prior", F.lit(False)))
    return g.guru_list(q, positions(u), changes(u)).select("manager", "period", "complete", "positions", "new", "sold_out")


@query("gur15_guru_view", "SELECT coalesce(p.security, c.security) AS security, coalesce(p.put_call, c.put_call) AS put_call, p.shares, p.value, p.weight, c.action, c.change_pct FROM (SELECT * FROM ox_fp WHERE manager = 7 AND period = (SELECT period FROM ox_fl WHERE manager = 7)) p FULL JOIN (SELECT * FROM ox_fc WHERE manager = 7 AND period = (SELECT period FROM ox_fl WHERE manager = 7)) c ON p.security = c.security AND p.put_call = c.put_call", r="weight change_pct")
def gur15(u):
    return g.guru_view(positions(u), changes(u), 7, quarters=quarters(u)).select("security", "put_call", "shares", "value", "weight", "action", "change_pct")


@query("gur15_omits_holdings", "SELECT manager, period, bool_or(o) AS omitted FROM (SELECT f.manager, f.period, f.filer, arg_max(confidential_omitted, f.o) AS o FROM ox_ff f JOIN ox_fs s ON s.accession = f.accession WHERE confidential_omitted IS NOT NULL AND NOT (NOT confidential_omitted AND adds) GROUP BY ALL) x GROUP BY ALL")
def gur15o(u):
    return g.omits_holdings(filings(u), standing(u))


@query("gur16_gurus_holding", "SELECT p.manager, p.period, p.ticker, p.put_call, p.shares, p.value, p.weight FROM ox_fp p JOIN ox_fl l ON l.manager = p.manager AND l.period = p.period WHERE p.ticker IN (SELECT b.ticker FROM si_fund_cusips a JOIN si_fund_cusips b ON substr(a.cusip, 1, 6) = substr(b.cusip, 1, 6) WHERE a.ticker = (SELECT min(ticker) FROM si_fund_cusips))", r="weight")
def gur16(u):
    first = u.fund_cusips.agg(F.min("ticker").alias("ticker"))
    classes = g.share_classes(u.fund_cusips).join(first, "ticker").withColumn("ticker", F.lit("first"))
    return g.gurus_holding("first", classes, positions(u), quarters(u)).select("manager", "period", "ticker", "put_call", "shares", "value", "weight")


@query("gur17_guru_portfolio", """SELECT h.security, gurus, shares, value, coalesce(buyers, 0) AS buyers, coalesce(sellers, 0) AS sellers FROM (SELECT security, count(*) AS gurus, sum(shares) AS shares, sum(value) AS value FROM ox_fp p JOIN ox_fl l ON l.manager = p.manager AND l.period = p.period WHERE put_call = '' GROUP BY ALL) h
LEFT JOIN (SELECT security, count(*) FILTER (action IN ('new', 'added')) AS buyers, count(*) FILTER (action IN ('reduced', 'sold_out')) AS sellers FROM ox_fc c JOIN ox_fl l ON l.manager = c.manager AND l.period = c.period WHERE put_call = '' GROUP BY ALL) c ON c.security = h.security ORDER BY gurus DESC, value DESC, h.security LIMIT 50""")
def gur17(u):
    return g.guru_portfolio(positions(u), changes(u), quarters(u), 50).drop("issuer")
