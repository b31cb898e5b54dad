"""The stand-in universe: company-like relations derived from the given tables.

Every relation is one SQL text that both Spark and the checking engine run, so a query's inputs are
the same on both sides and only the operator under test differs. Money is kept in whole dollars,
which doubles add exactly in any order.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from finstrata.session import ensure_checkpoint_dir

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

class _Relations(dict):
    """SQL by name; a name is given once."""

    def __setitem__(self, name: str, sql: str) -> None:
        if name in self:
            raise ValueError(f"relation {name} exists already")
        super().__setitem__(name, sql)


RELATIONS: dict[str, str] = _Relations()
#: Relations that Spark makes by other steps than their SQL's, row for row the same.
BUILT: dict[str, Callable[[Universe], DataFrame]] = {}

RELATIONS["si_company"] = """
SELECT concat('S', s_suppkey) AS ticker, concat('000', CAST(s_suppkey + 1000000 AS VARCHAR(20))) AS cik,
       s_name AS company_name,
       CASE s_nationkey % 8 WHEN 5 THEN 'bank' WHEN 6 THEN 'insurance' WHEN 7 THEN 'reit' ELSE 'general' END AS sector_class,
       n_name AS country, r_name AS region,
       CAST(1001 + (s_nationkey % 3) * 100 + (s_suppkey % 3) * 10 AS VARCHAR(4)) AS sic,
       concat('Trade ', CAST(s_nationkey % 3 AS VARCHAR(2)), CAST(s_suppkey % 2 AS VARCHAR(2))) AS sic_description,
       CAST(s_suppkey AS BIGINT) AS company_no, CAST(s_nationkey AS BIGINT) AS nation_no, s_acctbal AS account
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""

RELATIONS["si_flows"] = """
SELECT concat('S', l_suppkey) AS ticker,
       CAST(date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS period_end,
       CAST(year(l_shipdate) AS INT) AS fiscal_year, CAST(quarter(l_shipdate) AS INT) AS fiscal_quarter,
       CAST(sum(CAST(floor(l_extendedprice * (1 - l_discount)) AS BIGINT)) AS BIGINT) AS revenue,
       CAST(sum(CAST(floor(l_extendedprice * (0.45 + 0.015 * s_nationkey)) AS BIGINT)) AS BIGINT) AS cost,
       CAST(sum(CAST(floor(l_extendedprice * l_tax) AS BIGINT)) AS BIGINT) AS da,
       CAST(sum(CAST(floor(l_extendedprice * 0.1) AS BIGINT)) AS BIGINT) AS sga,
       CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(floor(l_extendedprice * 0.1) AS BIGINT) END) AS BIGINT) AS capex,
       CAST(sum(CASE WHEN l_returnflag = 'A' THEN CAST(floor(l_extendedprice * 0.04) AS BIGINT) END) AS BIGINT) AS interest,
       CAST(sum(CASE WHEN l_linestatus = 'F' THEN CAST(floor(l_extendedprice * 0.05) AS BIGINT) ELSE 0 END) AS BIGINT) AS paid_late,
       CAST(count(*) AS BIGINT) AS n_lines, max(s_nationkey) AS nation_no, max(s_acctbal) AS account
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
GROUP BY l_suppkey, date_trunc('quarter', l_shipdate), year(l_shipdate), quarter(l_shipdate)
"""

RELATIONS["si_income"] = """
SELECT ticker, period_end, fiscal_year, fiscal_quarter, revenue, cost, da, sga, capex, interest, paid_late, n_lines,
       CAST(nation_no AS BIGINT) AS nation_no, account, operating, pretax, tax, pretax - tax AS net,
       CASE WHEN account > 0 AND pretax - tax > 0 THEN CAST(floor((pretax - tax) * 0.3) AS BIGINT) END AS dividends
FROM (SELECT *, CASE WHEN pretax > 0 THEN CAST(floor(pretax * 0.21) AS BIGINT) ELSE 0 END AS tax
      FROM (SELECT *, revenue - cost - sga - da AS operating,
                   revenue - cost - sga - da - coalesce(interest, 0) AS pretax FROM si_flows) a) b
"""

# One quarter per company with flows and the balance sheet at its end, canonical names.
RELATIONS["si_quarterly"] = """
SELECT ticker, period_end, fiscal_year, fiscal_quarter,
       CAST(revenue AS DOUBLE) AS revenue, CAST(cost AS DOUBLE) AS cost_of_revenue,
       CAST(CASE WHEN nation_no % 4 = 1 THEN NULL ELSE revenue - cost END AS DOUBLE) AS gross_profit,
       CAST(sga AS DOUBLE) AS sga_expense, CAST(operating AS DOUBLE) AS operating_income,
       CAST(interest AS DOUBLE) AS interest_expense, CAST(pretax AS DOUBLE) AS pretax_income,
       CAST(tax AS DOUBLE) AS income_tax_expense, CAST(net AS DOUBLE) AS net_income,
       CAST(da AS DOUBLE) AS depreciation_amortization, CAST(capex AS DOUBLE) AS capex,
       CAST(net + da - paid_late AS DOUBLE) AS operating_cash_flow,
       CAST(-coalesce(capex, 0) - paid_late AS DOUBLE) AS investing_cash_flow,
       CAST(-coalesce(dividends, 0) AS DOUBLE) AS financing_cash_flow,
       CAST(da - coalesce(capex, 0) - 2 * paid_late + net - coalesce(dividends, 0)
            + CASE WHEN n_lines % 5 = 0 THEN 90000 ELSE 0 END AS DOUBLE) AS net_change_in_cash,
       CAST(dividends AS DOUBLE) AS dividends_paid,
       CAST(net AS DOUBLE) / (90000 + 400 * (nation_no % 5) * seq) AS eps_diluted,
       CAST(90000 + 400 * (nation_no % 5) * seq AS DOUBLE) AS weighted_avg_shares_diluted,
       CAST(90500 + 400 * (nation_no % 5) * seq AS DOUBLE) AS shares_outstanding,
       CAST(floor(revenue * 0.5) AS DOUBLE) AS accounts_receivable, CAST(floor(cost * 0.4) AS DOUBLE) AS inventory,
       CAST(cash AS DOUBLE) AS cash_and_equivalents,
       CAST(CASE WHEN nation_no % 6 = 2 THEN 40000 END AS DOUBLE) AS short_term_investments,
       CAST(cash + floor(revenue * 0.5) + floor(cost * 0.4) + 50000 AS DOUBLE) AS current_assets,
       CAST(floor(cost * 0.5) + std AS DOUBLE) AS current_liabilities,
       CAST(std AS DOUBLE) AS short_term_debt,
       CAST(CASE WHEN nation_no % 7 = 3 THEN NULL ELSE 200000 + 30000 * nation_no + 4000 * seq END AS DOUBLE) AS long_term_debt,
       CAST(CASE WHEN nation_no % 9 = 4 THEN 25000 END AS DOUBLE) AS commercial_paper,
       CAST(ppe AS DOUBLE) AS ppe_net, CAST(CASE WHEN nation_no % 3 = 0 THEN 350000 END AS DOUBLE) AS goodwill,
       CAST(equity AS DOUBLE) AS total_equity, CAST(kept AS DOUBLE) AS retained_earnings,
       CAST(cash + floor(revenue * 0.5) + floor(cost * 0.4) + 50000 + ppe
            + CASE WHEN nation_no % 3 = 0 THEN 350000 ELSE 0 END AS DOUBLE) AS total_assets,
       CAST(CASE WHEN nation_no % 5 = 4 THEN NULL
                 ELSE cash + floor(revenue * 0.5) + floor(cost * 0.4) + 50000 + ppe
                      + CASE WHEN nation_no % 3 = 0 THEN 350000 ELSE 0 END - equity
                      - CASE WHEN n_lines % 7 = 0 THEN 120000 ELSE 0 END END AS DOUBLE) AS total_liabilities,
       CAST(CASE WHEN nation_no % 8 = 5 THEN revenue - cost END AS DOUBLE) AS net_interest_income,
       CAST(CASE WHEN nation_no % 8 = 5 THEN floor(revenue * 0.3) END AS DOUBLE) AS noninterest_income,
       CAST(CASE WHEN nation_no % 8 = 5 THEN sga + floor(cost * 0.2) END AS DOUBLE) AS noninterest_expense,
       CAST(CASE WHEN nation_no % 8 = 5 THEN revenue * 3 END AS DOUBLE) AS total_loans,
       CAST(CASE WHEN nation_no % 8 = 5 THEN cost * 4 END AS DOUBLE) AS total_deposits,
       CAST(CASE WHEN nation_no % 8 = 6 THEN floor(revenue * 0.9) END AS DOUBLE) AS premiums_earned,
       CAST(CASE WHEN nation_no % 8 = 6 THEN floor(cost * 0.9) END AS DOUBLE) AS claims_incurred,
       CAST(CASE WHEN nation_no % 8 = 6 THEN cost + sga END AS DOUBLE) AS benefits_and_expenses
FROM (SELECT *,
             CAST(floor(account * 40) AS BIGINT) + 400000 + kept AS equity,
             CAST(60000 + floor(revenue * 0.2) AS BIGINT) AS cash,
             CAST(CASE WHEN nation_no % 7 = 3 THEN NULL ELSE floor(cost * 0.1) + 10000 END AS BIGINT) AS std,
             900000 + spent - worn AS ppe
      FROM (SELECT *,
                   CAST(row_number() OVER (PARTITION BY ticker ORDER BY period_end) AS BIGINT) AS seq,
                   CAST(sum(net - coalesce(dividends, 0)) OVER (PARTITION BY ticker ORDER BY period_end) AS BIGINT) AS kept,
                   CAST(sum(coalesce(capex, 0)) OVER (PARTITION BY ticker ORDER BY period_end) AS BIGINT) AS spent,
                   CAST(sum(da) OVER (PARTITION BY ticker ORDER BY period_end) AS BIGINT) AS worn
            FROM si_income) a) b
"""

FLOWS = ("revenue cost_of_revenue gross_profit sga_expense operating_income interest_expense pretax_income income_tax_expense "
         "net_income depreciation_amortization capex operating_cash_flow investing_cash_flow financing_cash_flow "
         "net_change_in_cash dividends_paid net_interest_income noninterest_income noninterest_expense premiums_earned "
         "claims_incurred benefits_and_expenses").split()
INSTANTS = ("accounts_receivable inventory cash_and_equivalents short_term_investments current_assets current_liabilities "
            "short_term_debt long_term_debt commercial_paper ppe_net goodwill total_equity retained_earnings total_assets "
            "total_liabilities total_loans total_deposits shares_outstanding weighted_avg_shares_diluted").split()


def _annual(year: str) -> str:
    flows = ",\n       ".join(f"sum({c}) AS {c}" for c in FLOWS)
    points = ",\n       ".join(f"max_by({c}, CASE WHEN {c} IS NOT NULL THEN period_end END) AS {c}" for c in INSTANTS)
    return f"""
SELECT q.*, net_income / weighted_avg_shares_diluted AS eps_diluted,
       dividends_paid / weighted_avg_shares_diluted AS dividends_per_share,
       total_equity / shares_outstanding AS book_per_share
FROM (SELECT ticker, CAST({year} AS INT) AS fiscal_year, max(period_end) AS period_end,
       {flows},
       {points}
FROM si_quarterly GROUP BY ticker, {year}) q
"""


# Half years stand in for fiscal years, so that the ten-year windows of the scores and models fill.
RELATIONS["si_annual"] = _annual("1988 + 2 * (fiscal_year - 1995) + CASE WHEN fiscal_quarter > 2 THEN 1 ELSE 0 END")
# Calendar fiscal years, which the quarters sum to.
RELATIONS["si_annual_cal"] = _annual("fiscal_year")

RELATIONS["si_bars"] = """
SELECT concat('S', l_suppkey) AS ticker, CAST(l_shipdate AS DATE) AS date,
       min_by(l_extendedprice / 1000, l_orderkey * 10 + l_linenumber) AS open,
       max(l_extendedprice / 1000) AS high, min(l_extendedprice / 1000) AS low,
       max_by(l_extendedprice / 1000, l_orderkey * 10 + l_linenumber) AS close, sum(l_quantity) AS volume
FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE)
"""

# The last quote of each month as a snapshot.
RELATIONS["si_snapshots"] = """
SELECT b.ticker, CAST(b.day AS TIMESTAMP) AS collected_at, b.close AS current_price,
       lag(b.close) OVER (PARTITION BY b.ticker ORDER BY b.day) AS previous_close,
       CAST(90500 AS DOUBLE) AS shares_outstanding, b.close * 90500 AS market_cap,
       CAST(CASE WHEN c.nation_no % 11 = 7 THEN NULL ELSE 0.5 + 0.05 * c.nation_no END AS DOUBLE) AS beta,
       CAST(0.043 AS DOUBLE) AS risk_free_rate
FROM (SELECT ticker, max(date) AS day, max_by(close, date) AS close FROM si_bars
      GROUP BY ticker, date_trunc('month', date)) b JOIN si_company c ON b.ticker = c.ticker
"""

# A line sold at the full discount pays a dividend on the day it ships.
RELATIONS["si_dividends"] = """
SELECT concat('S', l_suppkey) AS ticker, CAST(l_shipdate AS DATE) AS date,
       CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS DOUBLE) / 100000 AS amount, CAST(count(*) AS BIGINT) AS payments
FROM lineitem WHERE l_discount >= 0.095 GROUP BY l_suppkey, CAST(l_shipdate AS DATE)
"""

# A full-quantity, top-tax line marks a split; its ratio comes from the return flag and status.
RELATIONS["si_splits"] = """
SELECT concat('S', l_suppkey) AS ticker, CAST(l_shipdate AS DATE) AS date,
       max(CAST(CASE WHEN l_returnflag = 'R' THEN 2.0 WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 1.5
                WHEN l_returnflag = 'A' THEN 0.5 WHEN l_linestatus = 'F' THEN 1.061 ELSE 3.0 END AS DOUBLE)) AS ratio
FROM lineitem WHERE l_quantity >= 49 AND l_tax >= 0.075 GROUP BY l_suppkey, CAST(l_shipdate AS DATE)
"""

# One fact per line: an order is the filing, the return flag ranks the tag, the order status names the form.
RELATIONS["si_facts"] = """
SELECT concat('S', l_suppkey) AS ticker,
       CASE l_returnflag WHEN 'N' THEN 'Revenues' WHEN 'A' THEN 'RevenueFromContractWithCustomerExcludingAssessedTax'
                         ELSE 'SalesRevenueNet' END AS tag,
       'USD' AS unit, CAST(date_trunc('year', l_shipdate) AS DATE) AS start,
       CAST(date_trunc('year', l_shipdate) + INTERVAL 1 YEAR - INTERVAL 1 DAY AS DATE) AS "end",
       CAST(floor(l_extendedprice) AS DOUBLE) AS val, CAST(l_orderkey AS VARCHAR(20)) AS accn,
       CASE o_orderstatus WHEN 'F' THEN '10-K' WHEN 'O' THEN '10-K/A' ELSE '10-Q' END AS form,
       CAST(CAST(date_trunc('month', o_orderdate) AS DATE) + INTERVAL 15 MONTH AS DATE) AS filed,
       CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS entry
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""

# Purchases are insider buys, errors are sales; the tenth of the hour plays the trading day.
RELATIONS["si_trades"] = """
SELECT concat('S', CAST(user_id % 20 AS VARCHAR(4))) AS ticker, concat('A', CAST(event_id AS VARCHAR(20))) AS accession,
       CAST(user_id AS BIGINT) AS owner_cik, CAST(ts AS DATE) AS date,
       CASE event_type WHEN 'purchase' THEN 'P' WHEN 'error' THEN 'S' WHEN 'signup' THEN 'M' ELSE 'F' END AS code,
       CAST(value AS DOUBLE) AS price, CAST(floor(value * 3) + 1 AS DOUBLE) AS shares,
       user_id % 20 < 3 AND user_id % 5 = 1 AS is_ceo_cfo, event_id % 4 = 1 AS aff10b5one, event_type
FROM events
"""

# A customer group is a fund manager, an order quarter its report, a part group the security held.
RELATIONS["si_positions"] = """
SELECT CAST(o_custkey % 40 AS BIGINT) AS manager,
       CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS period,
       CAST(l_partkey % 200 AS BIGINT) AS security, sum(l_quantity) AS shares,
       CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS DOUBLE) AS value
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
GROUP BY o_custkey % 40, date_trunc('quarter', o_orderdate), l_partkey % 200
"""

# Daily yields from discounts and taxes, monthly index and earnings, quarterly equities and output.
RELATIONS["si_series"] = """
SELECT 'ust:10y' AS series, CAST(l_shipdate AS DATE) AS date, CAST(sum(CAST(floor(l_discount * 100 + 0.5) AS BIGINT)) AS DOUBLE) / count(*) AS value
FROM lineitem GROUP BY CAST(l_shipdate AS DATE)
UNION ALL
SELECT 'ust:3m', CAST(l_shipdate AS DATE), CAST(sum(CAST(floor(l_tax * 100 + 0.5) AS BIGINT)) AS DOUBLE) / count(*) + 1
FROM lineitem GROUP BY CAST(l_shipdate AS DATE)
UNION ALL
SELECT 'ust:2y', CAST(l_shipdate AS DATE), CAST(sum(CAST(floor(l_quantity) AS BIGINT)) AS DOUBLE) / count(*) / 5
FROM lineitem GROUP BY CAST(l_shipdate AS DATE)
UNION ALL
SELECT 'shiller:real_price', CAST(date_trunc('month', l_shipdate) AS DATE), CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS DOUBLE) / count(*)
FROM lineitem GROUP BY date_trunc('month', l_shipdate)
UNION ALL
SELECT 'shiller:real_earnings', CAST(date_trunc('month', l_shipdate) AS DATE), CAST(sum(CAST(floor(l_extendedprice * l_tax) AS BIGINT)) AS DOUBLE) / count(*)
FROM lineitem GROUP BY date_trunc('month', l_shipdate)
UNION ALL
SELECT 'shiller:cape', CAST(date_trunc('month', l_shipdate) AS DATE), CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS DOUBLE) / sum(CAST(floor(l_extendedprice * l_tax) AS BIGINT))
FROM lineitem GROUP BY date_trunc('month', l_shipdate)
UNION ALL
SELECT 'fred:equities', CAST(date_trunc('quarter', o_orderdate) AS DATE), CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS DOUBLE)
FROM orders GROUP BY date_trunc('quarter', o_orderdate)
UNION ALL
SELECT 'fred:gdp', CAST(date_trunc('quarter', l_shipdate) AS DATE), CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS DOUBLE)
FROM lineitem GROUP BY date_trunc('quarter', l_shipdate)
"""

_NAME = re.compile(r"\b(?:si|ox)_[a-z_0-9]+\b")


def _closure(text: str, seen: list[str]) -> None:
    for name in dict.fromkeys(_NAME.findall(text)):
        if name in RELATIONS and name not in seen:
            _closure(RELATIONS[name], seen)
            if name not in seen:
                seen.append(name)


def with_relations(sql: str) -> str:
    """*sql* with the stand-in relations it names as leading CTEs (*sql* may itself start with WITH)."""
    needed: list[str] = []
    _closure(sql, needed)
    ctes = ", ".join(f"{n} AS ({RELATIONS[n].strip()})" for n in needed)
    body = sql.strip()
    if not ctes:
        return body
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"


_SHARED: dict[tuple[str, str, str], DataFrame] = {}
_WRITTEN: dict[tuple[str, str, str], str] = {}
# Row-for-row views of a table, cheap to derive again, and one that a single relation reads: not written.
_NARROW = {"si_company", "si_facts", "si_trades", "si_f_current"}


class Universe:
    """The relations over one data folder, each built when first asked for.

    A derived relation is written once as a table in the shared checkpoint folder and read back. The
    queries of a session share it, its lineage is cut, and losing an executor loses nothing.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def relation(self, name: str) -> DataFrame:
        sql = RELATIONS[name].replace('"end"', "`end`")
        used = {t: self.table(t) for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", sql)}
        used |= {n: getattr(self, n[3:]) for n in dict.fromkeys(_NAME.findall(sql))}
        for t in used:
            sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
        return self.spark.sql(sql, **used)

    def __getattr__(self, name: str) -> DataFrame:
        if f"si_{name}" not in RELATIONS:
            raise AttributeError(name)
        full = f"si_{name}"
        if full in _NARROW:
            return self.relation(full)
        return self.shared(full, lambda: BUILT.get(full, lambda u: u.relation(full))(self))

    def shared(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """*build*'s result, written once per application and data folder."""
        key = (self.spark.sparkContext.applicationId, self.dir, name)
        if key not in _SHARED:
            path = f"{ensure_checkpoint_dir(self.spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
            build().write.parquet(path)
            _SHARED[key] = self.spark.read.parquet(path)
            _WRITTEN[key] = path
        return _SHARED[key]


def forget_shared(spark: SparkSession | None = None) -> None:
    """Forgets the shared relations, so that the next query derives its inputs again; with a session their files go too."""
    if spark is not None:
        path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for path in _WRITTEN.values():
            p = path_of(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _WRITTEN.clear()
    _SHARED.clear()
