"""SCO, RNK and IND over the stand-in universe (half years as fiscal years)."""

from pyspark.sql import functions as F

from finstrata.operators import ranks as rk
from finstrata.operators import scores as sc
from finstrata.operators import valuation as v
from finstrata.plans import standin
from finstrata.plans.catalog import b_ratios as B
from finstrata.plans.catalog import c_history as H
from finstrata.plans.catalog import d_valuation as D
from finstrata.plans.catalog._core import query


def _annual(u):
    return u.annual.withColumns({"shares": F.col("weighted_avg_shares_diluted"), "eps": F.col("eps_diluted")})


def rows(u):
    return u.shared("score_rows", lambda: sc.annual_rows(_annual(u), u.company))


def fundamentals(u):
    return u.shared("fundamentals", lambda: sc.fundamentals(_annual(u), u.company))


def scores(u):
    return u.shared("scores", lambda: sc.compute_scores(fundamentals(u), D.market(u)))


def history(u):
    def build():
        value = H.latest_value(u)
        pe = H.latest_ranges(u).where(F.col("metric") == "pe").select("ticker", F.col("pct_rank").alias("pe_pct_rank"))
        return value.join(pe, "ticker", "left").select("ticker", (F.col("close") / F.col("fair_value")).alias("price_to_value"), "pe_pct_rank")
    return u.shared("score_history", build)


def momentum(u):
    return u.shared("momentum", lambda: sc.momentum(u.bars.select("ticker", "date", "close"), D.market(u).select("ticker", "beta")))


def components(u):
    return u.shared("rank_components", lambda: sc.rank_components(scores(u), history(u), momentum(u)))


_DEBT, _EBITDA, _FCF, _NOPAT, _NETDEBT = B._DEBT, B._EBITDA, B._FCF, B._NOPAT, B._NETDEBT
_nofin = "sector_class NOT IN ('bank', 'insurance')"
standin.RELATIONS["ox_rows"] = f"""
SELECT r.*, revenue / shares AS revenue_ps, ebitda / shares AS ebitda_ps, free_cash_flow / shares AS fcf_ps, total_equity / shares AS book_ps,
  CASE WHEN NOT debt_unknown THEN coalesce(total_debt, CASE WHEN coalesce(long_term_debt, short_term_debt, commercial_paper) IS NOT NULL THEN coalesce(long_term_debt, 0) + coalesce(short_term_debt, 0) + coalesce(commercial_paper, 0) END) END AS debt,
  coalesce(gross_profit, revenue - cost_of_revenue) / nullif(revenue, 0) AS gm
FROM (SELECT * EXCLUDE (td, nd, ro), positive IS FALSE AND coalesce(interest_expense, 0) > 0 AS debt_unknown,
  CASE WHEN positive THEN td WHEN coalesce(interest_expense, 0) > 0 THEN NULL WHEN {_nofin} THEN 0 ELSE td END AS total_debt,
  CASE WHEN positive THEN nd WHEN coalesce(interest_expense, 0) > 0 THEN NULL WHEN {_nofin} THEN -(coalesce(cash_and_equivalents, 0) + coalesce(short_term_investments, 0)) ELSE nd END AS net_debt,
  CASE WHEN positive THEN ro WHEN coalesce(interest_expense, 0) > 0 THEN NULL WHEN {_nofin} THEN coalesce(ro, CASE WHEN sector_class <> 'reit' AND total_equity - coalesce(cash_and_equivalents, 0) > 0 THEN ({_NOPAT}) / (total_equity - coalesce(cash_and_equivalents, 0)) END) ELSE ro END AS roic
 FROM (SELECT a.*, sector_class, weighted_avg_shares_diluted AS shares, eps_diluted AS eps, max(fiscal_year) OVER (PARTITION BY a.ticker) AS last_fy,
   greatest(coalesce(long_term_debt, 0), coalesce(short_term_debt, 0), coalesce(commercial_paper, 0), coalesce(CASE WHEN sector_class <> 'bank' THEN {_DEBT} END, 0)) > 0 AS positive,
   CASE WHEN sector_class <> 'bank' THEN {_DEBT} END AS td, CASE WHEN sector_class <> 'bank' THEN {_NETDEBT} END AS nd,
   CASE WHEN {_nofin} AND sector_class <> 'reit' THEN {B._SQL['roic']} END AS ro,
   CASE WHEN sector_class NOT IN ('bank', 'insurance') THEN {_EBITDA} END AS ebitda, CASE WHEN sector_class <> 'bank' THEN operating_income END AS ebit,
   CASE WHEN sector_class NOT IN ('bank', 'reit') THEN {_FCF} END AS free_cash_flow,
   CASE WHEN sector_class <> 'bank' THEN {B._SQL['operating_margin']} END AS operating_margin,
   CASE WHEN sector_class <> 'bank' THEN {B._SQL['interest_coverage']} END AS interest_coverage
  FROM si_annual a JOIN si_company c ON a.ticker = c.ticker) p WHERE fiscal_year > last_fy - 11) r
"""
standin.RELATIONS["ox_cur"] = "SELECT * FROM ox_rows WHERE fiscal_year = last_fy"
for _k in (1, 2, 3, 5, 10):
    standin.RELATIONS[f"ox_b{_k}"] = f"SELECT * FROM ox_rows WHERE fiscal_year = last_fy - {_k}"

_ROWS = ["ebitda", "free_cash_flow", "total_debt", "net_debt", "roic", "shares", "eps", "revenue_ps", "ebitda_ps", "fcf_ps", "book_ps"]


@query("sco1_fundamentals", "SELECT ticker, fiscal_year, debt_unknown, ebitda, free_cash_flow, total_debt, net_debt, roic, shares, eps FROM ox_rows", r="roic eps")
def sco1(u):
    return rows(u).select("ticker", "fiscal_year", "debt_unknown", *_ROWS[:7])


@query("sco2_per_share", "SELECT ticker, fiscal_year, eps, revenue_ps, ebitda_ps, fcf_ps, book_ps FROM ox_rows", r="eps revenue_ps ebitda_ps fcf_ps book_ps")
def sco2(u):
    return rows(u).select("ticker", "fiscal_year", *_ROWS[6:])


_G = [(n, s, k) for n, s in sc.GROWTH_SERIES.items() for k in sc.GROWTH_YEARS]


@query("sco3_growth", "SELECT c.ticker, " + ", ".join(f"CASE WHEN c.{s} > 0 AND b{k}.{s} > 0 THEN power(c.{s} / b{k}.{s}, 1.0 / {k}) - 1 END AS {n}_cagr_{k}y" for n, s, k in _G)
       + " FROM ox_cur c " + " ".join(f"LEFT JOIN ox_b{k} b{k} ON c.ticker = b{k}.ticker" for k in sc.GROWTH_YEARS), r=" ".join(f"{n}_cagr_{k}y" for n, _, k in _G))
def sco3(u):
    return fundamentals(u).select("ticker", *[c.alias(n) for n, c in sc.growth_columns().items()])


_T = {
    "roa_positive": "c.net_income / nullif(c.total_assets, 0) > 0", "cfo_positive": "c.operating_cash_flow > 0",
    "roa_up": "c.net_income / nullif(c.total_assets, 0) > p.net_income / nullif(p.total_assets, 0)",
    "cfo_above_ni": "c.operating_cash_flow > c.net_income",
    "leverage_down": "p.long_term_debt / nullif(p.total_assets, 0) > c.long_term_debt / nullif(c.total_assets, 0)",
    "current_ratio_up": "c.current_assets / nullif(c.current_liabilities, 0) > p.current_assets / nullif(p.current_liabilities, 0)",
    "no_new_shares": "c.shares <= p.shares * 1.005", "gross_margin_up": "c.gm > p.gm",
    "asset_turnover_up": "c.revenue / nullif(c.total_assets, 0) > p.revenue / nullif(p.total_assets, 0)"}
_PAIR = "FROM ox_cur c LEFT JOIN ox_b1 p ON c.ticker = p.ticker LEFT JOIN ox_market m ON c.ticker = m.ticker"
standin.RELATIONS["ox_piotroski"] = (
    "SELECT ticker, " + ", ".join(f"CASE WHEN ok THEN {k} END AS t_{k}" for k in _T)
    + ", CASE WHEN ok THEN CAST(" + " + ".join(f"coalesce({k}::INT, 0)" for k in _T) + " AS INT) END AS piotroski_f, CASE WHEN ok THEN CAST("
    + " + ".join(f"({k} IS NOT NULL)::INT" for k in _T) + f" AS INT) END AS piotroski_tested FROM (SELECT c.ticker, c.{_nofin} AND p.ticker IS NOT NULL AS ok, "
    + ", ".join(f"{t} AS {k}" for k, t in _T.items()) + f" {_PAIR}) x")


@query("sco4_piotroski", "SELECT * FROM ox_piotroski")
def sco4(u):
    return scores(u).select("ticker", *[f"t_{k}" for k in _T], "piotroski_f", "piotroski_tested")


_Z = "1.2 * (c.current_assets - c.current_liabilities) / c.total_assets + 1.4 * c.retained_earnings / c.total_assets + 3.3 * c.operating_income / c.total_assets + 0.6 * m.market_cap / nullif(c.total_liabilities, 0) + c.revenue / c.total_assets"
standin.RELATIONS["ox_altman"] = f"SELECT c.ticker, CASE WHEN c.{_nofin} AND c.sector_class <> 'reit' THEN {_Z} END AS altman_z {_PAIR}"


@query("sco5_altman", "SELECT ticker, altman_z, CASE WHEN altman_z < 1.81 THEN 'distress' WHEN altman_z <= 2.99 THEN 'grey' WHEN altman_z IS NOT NULL THEN 'safe' END AS altman_zone FROM ox_altman", r="altman_z")
def sco5(u):
    return scores(u).select("ticker", "altman_z", "altman_zone")


def _chg(a, b):
    return f"(c.{a} / nullif(c.{b}, 0)) / nullif(p.{a} / nullif(p.{b}, 0), 0)"


def _q(t):
    return f"(1 - ({t}.current_assets + {t}.ppe_net) / nullif({t}.total_assets, 0))"


def _w(t):
    return f"({t}.depreciation_amortization / nullif({t}.depreciation_amortization + {t}.ppe_net, 0))"


def _l(t):
    return f"(({t}.current_liabilities + coalesce({t}.long_term_debt, 0)) / nullif({t}.total_assets, 0))"


_V = {"dsri": _chg("accounts_receivable", "revenue"), "gmi": "p.gm / nullif(c.gm, 0)", "aqi": f"{_q('c')} / nullif({_q('p')}, 0)",
      "sgi": "c.revenue / nullif(p.revenue, 0)", "depi": f"coalesce({_w('p')} / nullif({_w('c')}, 0), 1)",
      "sgai": f"coalesce({_chg('sga_expense', 'revenue')}, 1)", "lvgi": f"{_l('c')} / nullif({_l('p')}, 0)",
      "tata": "(c.net_income - c.operating_cash_flow) / nullif(c.total_assets, 0)"}
standin.RELATIONS["ox_beneish"] = ("SELECT *, -4.84 + " + " + ".join(f"({w}) * v_{k}" for k, w in sc.BENEISH_WEIGHTS.items()) + " AS beneish_m FROM (SELECT c.ticker, "
    + ", ".join(f"CASE WHEN c.{_nofin} AND c.sector_class <> 'reit' AND p.ticker IS NOT NULL THEN {e} END AS v_{k}" for k, e in _V.items()) + f" {_PAIR}) x")


@query("sco6_beneish", "SELECT * FROM ox_beneish", r="beneish_m " + " ".join(f"v_{k}" for k in _V))
def sco6(u):
    return scores(u).select("ticker", *[f"v_{k}" for k in _V], "beneish_m")


_SL = f"CASE WHEN c.{_nofin} THEN (c.net_income - c.operating_cash_flow - c.investing_cash_flow) / nullif(c.total_assets, 0) END"
standin.RELATIONS["ox_sloan"] = f"SELECT c.ticker, {_SL} AS sloan_ratio {_PAIR}"


@query("sco7_sloan", "SELECT ticker, sloan_ratio, CASE WHEN abs(sloan_ratio) <= 0.1 THEN 'low' WHEN abs(sloan_ratio) <= 0.25 THEN 'elevated' WHEN sloan_ratio IS NOT NULL THEN 'high' END AS sloan_zone FROM ox_sloan", r="sloan_ratio")
def sco7(u):
    return scores(u).select("ticker", "sloan_ratio", "sloan_zone")


_WACC = ("m.market_cap / (m.market_cap + coalesce(c.debt, 0)) * greatest(0.08, least(0.14, 0.043 + coalesce(beta, 1) * 0.045)) + coalesce(c.debt, 0) / (m.market_cap + coalesce(c.debt, 0))"
         " * coalesce(greatest(0.043, least(0.143, abs(c.interest_expense / CASE WHEN c.debt > 0 THEN c.debt END))), 0.043)"
         " * (1 - coalesce(CASE WHEN c.pretax_income > 0 THEN greatest(0, least(0.35, c.income_tax_expense / c.pretax_income)) END, 0.21))")
standin.RELATIONS["ox_wacc"] = f"SELECT c.ticker, CASE WHEN c.{_nofin} AND NOT c.debt_unknown AND m.market_cap > 0 THEN {_WACC} END AS wacc, c.roic {_PAIR}"


@query("sco8_wacc", "SELECT ticker, roic, wacc, roic - wacc AS roic_minus_wacc FROM ox_wacc", r="roic wacc roic_minus_wacc")
def sco8(u):
    return scores(u).select("ticker", "roic", "wacc", "roic_minus_wacc")


standin.RELATIONS["ox_stars"] = """
SELECT ticker, CASE WHEN n < 10 OR known < 10 THEN NULL WHEN loss THEN 1.0 WHEN sa <= 0 OR sb <= 0 THEN 1.0 ELSE floor((1 + 4 * least(ra, rb)) * 2) / 2 END AS predictability_stars,
  CASE WHEN n = 10 AND known = 10 AND NOT loss THEN ra END AS r2_revenue, CASE WHEN n = 10 AND known = 10 AND NOT loss THEN rb END AS r2_second
FROM (SELECT ticker, count(*) AS n, count(*) FILTER (revenue_ps IS NOT NULL AND s2 IS NOT NULL) AS known, bool_or(revenue_ps <= 0 OR s2 <= 0) AS loss,
   regr_slope(ln(CASE WHEN revenue_ps > 0 THEN revenue_ps END), fiscal_year) AS sa, regr_r2(ln(CASE WHEN revenue_ps > 0 THEN revenue_ps END), fiscal_year) AS ra,
   regr_slope(ln(CASE WHEN s2 > 0 THEN s2 END), fiscal_year) AS sb, regr_r2(ln(CASE WHEN s2 > 0 THEN s2 END), fiscal_year) AS rb
 FROM (SELECT *, CASE WHEN sector_class IN ('bank', 'insurance') THEN eps ELSE ebitda_ps END AS s2 FROM ox_rows WHERE fiscal_year > last_fy - 10) y GROUP BY ticker) z
"""


@query("sco9_predictability", "SELECT * FROM ox_stars", r="r2_revenue r2_second")
def sco9(u):
    return scores(u).select("ticker", "predictability_stars", "r2_revenue", "r2_second")


_EV = "(m.market_cap + coalesce(c.net_debt, 0))"
_CAPITAL = "(greatest((c.current_assets - coalesce(c.cash_and_equivalents, 0)) - (c.current_liabilities - coalesce(c.short_term_debt, 0)), 0) + c.ppe_net)"
standin.RELATIONS["ox_magic"] = f"""
SELECT c.ticker, c.sector_class, (c.current_assets - c.total_liabilities) / nullif(c.shares, 0) AS ncav_per_share, CASE WHEN c.ebitda > 0 THEN c.debt / c.ebitda END AS debt_to_ebitda,
 CASE WHEN c.{_nofin} AND NOT c.debt_unknown AND {_EV} > 0 THEN c.operating_income / {_EV} END AS earnings_yield,
 CASE WHEN c.{_nofin} AND c.short_term_debt IS NOT DISTINCT FROM c.short_term_debt AND {_CAPITAL} > 0 AND c.current_liabilities IS NOT NULL THEN c.operating_income / {_CAPITAL} END AS return_on_capital {_PAIR}
"""


@query("sco10_magic_inputs", "SELECT ticker, ncav_per_share, debt_to_ebitda, earnings_yield, return_on_capital FROM ox_magic", r="ncav_per_share debt_to_ebitda earnings_yield return_on_capital")
def sco10(u):
    return scores(u).select("ticker", "ncav_per_share", F.col("score_debt_to_ebitda").alias("debt_to_ebitda"), "earnings_yield", "return_on_capital")


_NAME = "CASE c.sector_class WHEN 'bank' THEN 'banks' WHEN 'insurance' THEN 'insurers' ELSE 'REITs' END"


def _miss(*pairs):
    return "'missing ' || list_aggregate(list_filter([" + ", ".join(f"CASE WHEN {c} IS NULL THEN '{n}' END" for c, n in pairs) + "], lambda x: x IS NOT NULL), 'string_agg', ', ')"


@query("sco11_na_reasons", f"""
SELECT c.ticker, CASE WHEN NOT c.{_nofin} THEN 'does not apply to ' || {_NAME} WHEN b1.ticker IS NULL THEN 'year ' || (c.fiscal_year - 1) || ' is not on file' END AS piotroski,
 CASE WHEN NOT c.{_nofin} OR c.sector_class = 'reit' THEN 'does not apply to ' || {_NAME} WHEN altman_z IS NULL THEN {_miss(('c.total_assets', 'total assets'), ('c.total_liabilities', 'total liabilities'), ('c.current_assets', 'current assets'), ('c.current_liabilities', 'current liabilities'))} END AS altman,
 CASE WHEN NOT c.{_nofin} OR c.sector_class = 'reit' THEN 'does not apply to ' || {_NAME} WHEN beneish_m IS NULL THEN {_miss(*[(f'v_{k}', k) for k in _V])} END AS beneish,
 CASE WHEN NOT c.{_nofin} THEN 'does not apply to ' || {_NAME} WHEN c.debt_unknown THEN '{sc.DEBT_UNKNOWN}' END AS wacc,
 CASE WHEN c.roic IS NOT NULL THEN NULL WHEN NOT c.{_nofin} OR c.sector_class = 'reit' THEN 'ROIC does not apply to ' || {_NAME} WHEN c.debt_unknown THEN 'ROIC unknown: {sc.DEBT_UNKNOWN}' ELSE 'ROIC undefined: the capital invested is not positive' END AS roic,
 CASE WHEN ncav_per_share IS NULL THEN {_miss(('c.current_assets', 'current assets'), ('c.total_liabilities', 'total liabilities'))} END AS ncav
FROM ox_cur c LEFT JOIN ox_b1 b1 ON c.ticker = b1.ticker JOIN ox_altman a ON a.ticker = c.ticker JOIN ox_beneish e ON e.ticker = c.ticker JOIN ox_magic g ON g.ticker = c.ticker
""")
def sco11(u):
    return scores(u).select("ticker", *[F.col("na_reasons")[k].alias(k) for k in ("piotroski", "altman", "beneish", "wacc", "roic", "ncav")])


standin.RELATIONS["ox_momentum"] = """
SELECT ticker, CASE WHEN p1 <> 0 AND p6 <> 0 AND p12 <> 0 THEN ((p1 / p12 - 1) + (p1 / p6 - 1)) / 2 / coalesce(greatest(beta, CASE WHEN beta IS NOT NULL THEN 0.5 END), 1) END AS momentum FROM (
SELECT l.ticker, beta, """ + ", ".join(f"(SELECT arg_max(close, date) FROM si_bars b WHERE b.ticker = l.ticker AND b.date <= last - INTERVAL {k} MONTH) AS p{k}" for k in (1, 6, 12)) + """
FROM (SELECT ticker, max(date) AS last FROM si_bars GROUP BY ticker) l LEFT JOIN ox_market m ON l.ticker = m.ticker) x
"""


@query("sco12_momentum", "SELECT * FROM ox_momentum", r="momentum")
def sco12(u):
    return momentum(u)


standin.RELATIONS["ox_ctx"] = """
SELECT o.ticker, o.close / v.fair_value AS price_to_value, s.pct_rank AS pe_pct_rank FROM ox_months o LEFT JOIN ox_value v ON o.ticker = v.ticker AND o.date = v.date
LEFT JOIN ox_stats s ON s.ticker = o.ticker AND s.date = o.date AND s.metric = 'pe' WHERE (o.ticker, o.date) IN (SELECT (ticker, max(date)) FROM ox_months GROUP BY ticker)
"""


def _cg(f, a="c", b="b3"):
    return f"CASE WHEN {a}.{f} > 0 AND {b}.{f} > 0 THEN power({a}.{f} / {b}.{f}, 1.0 / 3) - 1 END"


_TURN = "(c.{0} / nullif(c.revenue, 0)) / nullif(b3.{0} / nullif(b3.revenue, 0), 0)"
_SIGNS = [  # code, fires, value, threshold, severe
    ("altman_distress", "altman_z < 1.81", "altman_z", "1.81", "true"), ("beneish_flag", "beneish_m > -1.78", "beneish_m", "-1.78", "true"),
    ("sloan_high", "abs(sloan_ratio) > 0.1", "sloan_ratio", "CASE WHEN abs(sloan_ratio) > 0.25 THEN 0.25 ELSE 0.1 END", "abs(sloan_ratio) > 0.25"),
    ("piotroski_low", "piotroski_tested >= 7 AND piotroski_f <= 3", "piotroski_f", "3", "false"),
    ("interest_coverage_low", "c.interest_coverage < 3", "c.interest_coverage", "CASE WHEN c.interest_coverage < 1.5 THEN 1.5 ELSE 3 END", "c.interest_coverage < 1.5"),
    ("revenue_decline", "c.revenue < b1.revenue AND b1.revenue < b2.revenue AND b2.revenue < b3.revenue", "c.revenue", "b3.revenue", "false"),
    ("margin_decline", "c.operating_margin - b5.operating_margin < -0.05", "c.operating_margin - b5.operating_margin", "-0.05", "false"),
    ("fcf_negative", "b2.ticker IS NOT NULL AND b1.ticker IS NOT NULL AND (coalesce(c.free_cash_flow < 0, false)::INT + coalesce(b1.free_cash_flow < 0, false)::INT + coalesce(b2.free_cash_flow < 0, false)::INT) >= 2", "(coalesce(c.free_cash_flow < 0, false)::INT + coalesce(b1.free_cash_flow < 0, false)::INT + coalesce(b2.free_cash_flow < 0, false)::INT)", "2", "false"),
    ("dilution", f"{_cg('shares')} > 0.03", _cg("shares"), "0.03", "false"),
    ("debt_outgrows_revenue", f"({_cg('total_debt')}) - ({_cg('revenue')}) > 0.1", f"({_cg('total_debt')}) - ({_cg('revenue')})", "0.1", "false"),
    ("receivables_outgrow_revenue", _TURN.format("accounts_receivable") + " > 1.2", _TURN.format("accounts_receivable"), "1.2", "false"),
    ("inventory_outgrows_revenue", _TURN.format("inventory") + " > 1.2", _TURN.format("inventory"), "1.2", "false"),
    ("assets_outgrow_revenue", f"({_cg('total_assets')}) - ({_cg('revenue')}) > 0.1", f"({_cg('total_assets')}) - ({_cg('revenue')})", "0.1", "false"),
    ("goodwill_heavy", "c.total_equity > 0 AND c.goodwill > 0.5 * c.total_equity", "c.goodwill / nullif(c.total_equity, 0)", "0.5", "false"),
    ("negative_equity", "c.total_equity < 0", "c.total_equity", "0", "false"),
    ("payout_over_fcf", "c.dividends_paid > 0 AND c.dividends_paid > c.free_cash_flow", "c.dividends_paid", "c.free_cash_flow", "false"),
    ("roic_below_wacc", "w.roic < w.wacc", "w.roic", "w.wacc", "false"),
    ("price_far_above_value", "price_to_value > 1.3", "price_to_value", "1.3", "false"), ("pe_at_high", "pe_pct_rank >= 0.95", "pe_pct_rank", "0.95", "false"),
    ("gross_margin_decline", "c.gm - b5.gm < -0.05", "c.gm - b5.gm", "-0.05", "false")]
standin.RELATIONS["ox_signs"] = " UNION ALL ".join(
    f"""SELECT c.ticker, {i} AS position, '{code}' AS code, CASE WHEN {sev} THEN 'severe' ELSE 'medium' END AS severity, CAST({val} AS DOUBLE) AS value, CAST({thr} AS DOUBLE) AS threshold
FROM ox_cur c LEFT JOIN ox_b1 b1 ON b1.ticker = c.ticker LEFT JOIN ox_b2 b2 ON b2.ticker = c.ticker LEFT JOIN ox_b3 b3 ON b3.ticker = c.ticker LEFT JOIN ox_b5 b5 ON b5.ticker = c.ticker
JOIN ox_altman a ON a.ticker = c.ticker JOIN ox_beneish e ON e.ticker = c.ticker JOIN ox_sloan s ON s.ticker = c.ticker JOIN ox_piotroski p ON p.ticker = c.ticker JOIN ox_wacc w ON w.ticker = c.ticker LEFT JOIN ox_ctx x ON x.ticker = c.ticker
WHERE {fires}""" for i, (code, fires, val, thr, sev) in enumerate(_SIGNS))


def signs(u):
    return u.shared("signs", lambda: sc.warning_signs(scores(u), history(u)))


@query("sco13_warning_signs", "SELECT ticker, CAST(row_number() OVER (PARTITION BY ticker ORDER BY (severity <> 'severe')::INT, position) AS INT) AS place, code, severity, value, threshold FROM ox_signs", r="value threshold")
def sco13(u):
    return signs(u).drop("message")


def _med(col, n):
    return f"(SELECT CASE WHEN count({col}) >= 5 THEN {n}({col}) END FROM ox_rows y WHERE y.ticker = c.ticker AND y.fiscal_year > y.last_fy - 10)"


_COMP = {
    ("strength", "interest_coverage"): "least(c.interest_coverage, CASE WHEN c.interest_coverage IS NOT NULL THEN 100 END)", ("strength", "altman_z"): "altman_z",
    ("strength", "equity_to_assets"): "c.total_equity / nullif(c.total_assets, 0)",
    ("strength", "cash_to_debt"): "CASE WHEN c.total_debt = 0 AND coalesce(c.cash_and_equivalents, 0) <> 0 THEN 10 WHEN c.total_debt <> 0 AND c.cash_and_equivalents IS NOT NULL THEN least(10, c.cash_and_equivalents / c.total_debt) END",
    ("strength", "debt_to_revenue"): "c.total_debt / nullif(c.revenue, 0)", ("profitability", "operating_margin"): "c.operating_margin",
    ("profitability", "operating_margin_10y_mean"): _med("operating_margin", "avg"), ("profitability", "operating_margin_5y_slope"): "(c.operating_margin - b5.operating_margin) / 5",
    ("profitability", "piotroski_share"): "piotroski_f / nullif(piotroski_tested, 0)", ("profitability", "predictability_stars"): "predictability_stars",
    ("profitability", "roic_10y_median"): _med("roic", "median"),
    ("profitability", "profitable_years"): "(SELECT CASE WHEN count(net_income) >= 5 THEN count(*) FILTER (net_income > 0) / count(net_income) END FROM ox_rows y WHERE y.ticker = c.ticker AND y.fiscal_year > y.last_fy - 10)",
    ("growth", "rev_ps_cagr_3y"): _cg("revenue_ps"), ("growth", "rev_ps_cagr_5y"): "CASE WHEN c.revenue_ps > 0 AND b5.revenue_ps > 0 THEN power(c.revenue_ps / b5.revenue_ps, 1.0 / 5) - 1 END",
    ("growth", "eps_cagr_5y"): f"CASE WHEN NOT c.{_nofin} AND c.eps > 0 AND b5.eps > 0 THEN power(c.eps / b5.eps, 1.0 / 5) - 1 END",
    ("growth", "ebitda_ps_cagr_5y"): f"CASE WHEN c.{_nofin} AND c.ebitda_ps > 0 AND b5.ebitda_ps > 0 THEN power(c.ebitda_ps / b5.ebitda_ps, 1.0 / 5) - 1 END",
    ("valuation", "price_to_value"): "price_to_value", ("valuation", "pe_pct_rank"): "CASE WHEN price_to_value IS NULL THEN pe_pct_rank END", ("momentum", "momentum"): "momentum"}
standin.RELATIONS["ox_components"] = "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT c.ticker, c.sector_class, '{r}' AS rank, '{n}' AS component, CAST({e} AS DOUBLE) AS value FROM ox_base c" for (r, n), e in
    {k: x.replace("b5.operating_margin", "b5_om").replace("b3.", "b3_").replace("b5.", "b5_") for k, x in _COMP.items()}.items()) + ") q WHERE value IS NOT NULL"
standin.RELATIONS["ox_base"] = """
SELECT c.*, altman_z, piotroski_f, piotroski_tested, predictability_stars, momentum, price_to_value, pe_pct_rank, b5.operating_margin AS b5_om, b3.revenue_ps AS b3_revenue_ps,
  b5.revenue_ps AS b5_revenue_ps, b5.eps AS b5_eps, b5.ebitda_ps AS b5_ebitda_ps
FROM ox_cur c LEFT JOIN ox_b3 b3 ON b3.ticker = c.ticker LEFT JOIN ox_b5 b5 ON b5.ticker = c.ticker JOIN ox_altman a ON a.ticker = c.ticker JOIN ox_piotroski p ON p.ticker = c.ticker
JOIN ox_stars t ON t.ticker = c.ticker LEFT JOIN ox_momentum o ON o.ticker = c.ticker LEFT JOIN ox_ctx x ON x.ticker = c.ticker
"""


@query("rnk1_components", "SELECT * FROM ox_components", r="value")
def rnk1(u):
    return components(u)


_BRAND = "SELECT CAST(p_partkey AS VARCHAR) AS ticker, p_brand AS sector_class, 'part' AS component, floor(p_retailprice / 7) AS value FROM part"


@query("rnk2_percentile", f"SELECT ticker, sector_class, value, cume_dist() OVER (PARTITION BY sector_class ORDER BY value) AS higher, cume_dist() OVER (PARTITION BY sector_class ORDER BY value DESC) AS lower FROM ({_BRAND}) p", r="higher lower")
def rnk2(u):
    from finstrata.functions.scale import percentile_of
    p = u.table("part").select(F.col("p_partkey").cast("string").alias("ticker"), F.col("p_brand").alias("sector_class"), F.floor(F.col("p_retailprice") / 7).cast("double").alias("value"))
    up = percentile_of(p, ["sector_class"], "value", F.lit(False), "higher")
    return percentile_of(up, ["sector_class"], "value", F.lit(True), "lower")


standin.RELATIONS["ox_pct"] = """
SELECT ticker, sector_class, rank, component, value, CASE WHEN count(*) OVER (PARTITION BY sector_class, component) >= 10 THEN
  CASE WHEN low THEN cume_dist() OVER (PARTITION BY sector_class, component ORDER BY value DESC) ELSE cume_dist() OVER (PARTITION BY sector_class, component ORDER BY value) END ELSE
  CASE WHEN low THEN cume_dist() OVER (PARTITION BY component ORDER BY value DESC) ELSE cume_dist() OVER (PARTITION BY component ORDER BY value) END END AS pct
FROM (SELECT *, component IN ('debt_to_revenue', 'price_to_value', 'pe_pct_rank') AS low FROM (SELECT * REPLACE (round(value, 9) AS value) FROM ox_components) c) z
"""


def stable(u):
    """Components at nine decimals, so that ties do not hang on the last bit of a sum."""
    return components(u).withColumn("value", F.round("value", 9))


@query("rnk3_peer_percentiles", "SELECT ticker, rank, component, pct FROM ox_pct", r="pct")
def rnk3(u):
    return rk.peer_percentiles(stable(u)).select("ticker", "rank", "component", "pct")


_NEED = "CASE rank WHEN 'valuation' THEN 1 WHEN 'momentum' THEN 1 ELSE 2 END"


def _ranks_sql(source, prefix, composite):
    cols = ", ".join(f"max(d) FILTER (rank = '{r}') AS {prefix}{r}" for r in rk.RANKS)
    return (f"SELECT ticker, {cols}, CASE WHEN count(d) >= 4 THEN 10 * avg(d) END AS {composite} FROM (SELECT ticker, rank, CASE WHEN count(*) >= {_NEED} THEN CAST(greatest(1, ceil(10 * avg(pct) - 1e-9)) AS INT) END AS d "
            f"FROM ({source}) s GROUP BY ticker, rank) g GROUP BY ticker")


@query("rnk4_rank_universe", _ranks_sql("SELECT * FROM ox_pct", "rank_", "composite_score"), r="composite_score")
def rnk4(u):
    return rk.rank_universe(stable(u))


_MAGIC = """
SELECT ticker, ey_rank, roc_rank, row_number() OVER (ORDER BY ey_rank + roc_rank, ey_rank) AS magic_formula_rank FROM (
SELECT ticker, row_number() OVER (ORDER BY earnings_yield DESC, ticker) AS ey_rank, row_number() OVER (ORDER BY return_on_capital DESC, ticker) AS roc_rank FROM ox_magic
WHERE sector_class = 'general' AND earnings_yield IS NOT NULL AND return_on_capital IS NOT NULL) x"""


@query("rnk5_magic_rank", _MAGIC)
def rnk5(u):
    return rk.magic_rank(scores(u))


standin.RELATIONS["ox_groups"] = """
SELECT ticker, sic, CASE WHEN count(*) OVER (PARTITION BY substr(sic, 1, 3)) >= 10 THEN substr(sic, 1, 3) WHEN count(*) OVER (PARTITION BY substr(sic, 1, 2)) >= 10 THEN substr(sic, 1, 2) END AS industry_group FROM si_company
"""
standin.RELATIONS["ox_members"] = """
SELECT g.industry_group, c.ticker FROM (SELECT industry_group, count(*) AS n FROM ox_groups WHERE industry_group IS NOT NULL GROUP BY 1) g
JOIN ox_groups c ON CASE WHEN n >= 10 THEN c.industry_group = g.industry_group ELSE starts_with(c.sic, g.industry_group) END
"""


@query("rnk6_industry_groups", "SELECT * FROM ox_groups")
def rnk6(u):
    return rk.industry_groups(u.company)


@query("rnk7_industry_members", "SELECT * FROM ox_members")
def rnk7(u):
    return rk.industry_members(rk.industry_groups(u.company))


@query("rnk8_group_labels", """
SELECT m.industry_group, count(*) AS members, 'SIC ' || m.industry_group || coalesce(' (' || any_value(CASE WHEN within IS NOT NULL THEN CASE WHEN taken THEN 'with ' ELSE 'outside ' END || within END) || ')', '') || ': ' || any_value(top) AS label
FROM ox_members m LEFT JOIN (SELECT industry_group, string_agg(d, '; ' ORDER BY n DESC, d) AS top FROM (SELECT *, row_number() OVER (PARTITION BY industry_group ORDER BY n DESC, d) AS k FROM (SELECT industry_group, sic_description AS d, count(*) AS n FROM ox_members JOIN si_company USING (ticker) GROUP BY 1, 2) v) x WHERE k <= 3 GROUP BY 1) t ON t.industry_group = m.industry_group
LEFT JOIN (SELECT a.industry_group, string_agg(DISTINCT b.industry_group, ', ' ORDER BY b.industry_group) AS within FROM (SELECT DISTINCT industry_group FROM ox_groups WHERE length(industry_group) = 2) a JOIN (SELECT DISTINCT industry_group FROM ox_groups WHERE length(industry_group) = 3) b ON starts_with(b.industry_group, a.industry_group) GROUP BY 1) w ON w.industry_group = m.industry_group
LEFT JOIN (SELECT m.industry_group, bool_or(g.industry_group <> m.industry_group) AS taken FROM ox_members m JOIN ox_groups g USING (ticker) GROUP BY 1) k ON k.industry_group = m.industry_group
GROUP BY m.industry_group
""")
def rnk8(u):
    return rk.group_labels(rk.industry_groups(u.company), u.company)


_IND = """SELECT ticker, rank, component, pct FROM (SELECT m.industry_group, c.*, count(*) OVER g AS n, CASE WHEN component IN ('debt_to_revenue', 'price_to_value', 'pe_pct_rank') THEN cume_dist() OVER (PARTITION BY m.industry_group, component ORDER BY value DESC)
 ELSE cume_dist() OVER (PARTITION BY m.industry_group, component ORDER BY value) END AS pct FROM ox_members m JOIN (SELECT * REPLACE (round(value, 9) AS value) FROM ox_components) c ON m.ticker = c.ticker WINDOW g AS (PARTITION BY m.industry_group, component)) p
 WHERE n >= 10 AND EXISTS (SELECT 1 FROM ox_groups o WHERE o.ticker = p.ticker AND o.industry_group = p.industry_group)"""


@query("rnk9_rank_industries", _ranks_sql(_IND, "ind_rank_", "ind_composite"), r="ind_composite")
def rnk9(u):
    return rk.rank_industries(stable(u), rk.industry_groups(u.company))


@query("rnk10_industry_options", """
SELECT prefix, size, 'SIC ' || prefix || ': ' || top AS label FROM (SELECT prefix, CAST(sum(n) AS BIGINT) AS size, string_agg(d, '; ' ORDER BY n DESC, d) FILTER (k <= 3) AS top FROM (
 SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY n DESC, d) AS k FROM (SELECT prefix, d, count(*) AS n FROM (SELECT substr(sic, 1, 3) AS prefix, sic_description AS d FROM si_company UNION ALL SELECT substr(sic, 1, 2), sic_description FROM si_company) x GROUP BY 1, 2) w) y GROUP BY prefix) z
""")
def rnk10(u):
    return rk.industry_options(u.company)


@query("rnk11_rank_all", f"""
SELECT c.ticker, rank_strength, rank_growth, composite_score, magic_formula_rank, industry_group, ind_rank_strength, ind_composite FROM ox_cur c
LEFT JOIN ({_ranks_sql('SELECT * FROM ox_pct', 'rank_', 'composite_score')}) u ON u.ticker = c.ticker LEFT JOIN ({_MAGIC}) m ON m.ticker = c.ticker LEFT JOIN ox_groups g ON g.ticker = c.ticker
LEFT JOIN ({_ranks_sql(_IND, 'ind_rank_', 'ind_composite')}) i ON i.ticker = c.ticker
""", r="composite_score ind_composite")
def rnk11(u):
    return u.shared("ranks", lambda: rk.rank_all(stable(u), scores(u), u.company)).select(
        "ticker", "rank_strength", "rank_growth", "composite_score", "magic_formula_rank", "industry_group", "ind_rank_strength", "ind_composite")


# ---- IND

_ISEL = ["ticker", "applicable", "na_reason", "value_bear", "value_base", "value_bull"]
_DCF = D._at(D.DCF_SQL)
_STEP = D.dcf_sql("basis", "shares_used", "((lo + hi) / 2)", "discount_base")
standin.RELATIONS["ox_i_reverse_dcf"] = f"""
SELECT ticker, na_reason IS NULL AS applicable, na_reason, CAST(NULL AS DOUBLE) AS value_bear, CASE WHEN na_reason IS NULL THEN g END AS value_base, CAST(NULL AS DOUBLE) AS value_bull FROM (
SELECT d.ticker, b.g, CASE WHEN NOT applicable THEN 'no DCF: ' || na_reason WHEN {D.dcf_sql('basis', 'shares_used', '(-0.5)', 'discount_base')} > current_price THEN 'the price is below the DCF''s value at -50% growth a year'
  WHEN {D.dcf_sql('basis', 'shares_used', '1.0', 'discount_base')} < current_price THEN 'the price is above the DCF''s value at 100% growth a year' END AS na_reason
FROM ({_DCF}) d JOIN ox_market m ON d.ticker = m.ticker LEFT JOIN (
  WITH RECURSIVE bis(ticker, basis, shares_used, discount_base, p, lo, hi, step) AS (
    SELECT d.ticker, basis, shares_used, discount_base, current_price, CAST(-0.5 AS DOUBLE), CAST(1.0 AS DOUBLE), 0 FROM ({_DCF}) d JOIN ox_market m ON d.ticker = m.ticker WHERE applicable
    UNION ALL SELECT ticker, basis, shares_used, discount_base, p, CASE WHEN {_STEP} < p THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {_STEP} < p THEN hi ELSE (lo + hi) / 2 END, step + 1 FROM bis WHERE step < 24)
  SELECT ticker, (lo + hi) / 2 AS g FROM bis WHERE step = 24) b ON b.ticker = d.ticker) x
"""


def reverse_dcf(u):
    return v.reverse_dcf(D.results(u).where(F.col("model") == "dcf"), D.market(u), D.as_of())


@query("ind1_reverse_dcf", "SELECT * FROM ox_i_reverse_dcf", r="value_base")
def ind1(u):
    return reverse_dcf(u).select(*_ISEL)


_ADJ = "mean_m * c.revenue * (1 - coalesce(CASE WHEN c.pretax_income > 0 THEN greatest(0, least(0.35, c.income_tax_expense / c.pretax_income)) END, 0.21))"


def _epv(d):
    return f"({_ADJ}) / (w.wacc {d}) - coalesce(c.debt, 0) + coalesce(c.cash_and_equivalents, 0) + coalesce(c.short_term_investments, 0)"


standin.RELATIONS["ox_i_epv"] = f"""
SELECT ticker, na_reason IS NULL AS applicable, na_reason, CASE WHEN na_reason IS NULL THEN b1 END AS value_bear, CASE WHEN na_reason IS NULL THEN b2 END AS value_base, CASE WHEN na_reason IS NULL THEN b3 END AS value_bull FROM (
SELECT c.ticker, ({_epv('+ 0.01')}) / 90500 AS b1, ({_epv('')}) / 90500 AS b2, ({_epv('- 0.01')}) / 90500 AS b3,
 CASE WHEN c.sector_class <> 'general' THEN 'does not apply to ' || {_NAME} WHEN c.debt_unknown THEN '{sc.DEBT_UNKNOWN}' WHEN {_ADJ} <= 0 THEN 'normalized after-tax operating earnings are not positive' END AS na_reason
FROM ox_cur c JOIN ox_wacc w ON w.ticker = c.ticker JOIN (SELECT ticker, avg(operating_income / revenue) FILTER (revenue > 0) AS mean_m FROM ox_rows WHERE fiscal_year > last_fy - 5 GROUP BY ticker) a ON a.ticker = c.ticker) x
"""


def epv(u):
    return v.epv(rows(u), D.market(u), sc.wacc, sc._debt(), D.as_of())


@query("ind2_epv", "SELECT * FROM ox_i_epv", r="value_bear value_base value_bull")
def ind2(u):
    return epv(u).select(*_ISEL)


standin.RELATIONS["ox_i_ncav"] = """
SELECT ticker, na_reason IS NULL AS applicable, na_reason, CASE WHEN na_reason IS NULL AND nn > 0 THEN nn END AS value_bear, CASE WHEN na_reason IS NULL THEN nc END AS value_base, CAST(NULL AS DOUBLE) AS value_bull FROM (
SELECT *, CASE WHEN sector_class IN ('bank', 'insurance') THEN 'does not apply to ' || CASE sector_class WHEN 'bank' THEN 'banks' ELSE 'insurers' END || ' (no current assets)' WHEN nc IS NULL THEN 'no current assets or total liabilities' WHEN nc <= 0 THEN 'net current assets are negative: total liabilities exceed current assets' END AS na_reason
FROM (SELECT ticker, sector_class, (current_assets - total_liabilities) / shares AS nc, (coalesce(cash_and_equivalents, 0) + coalesce(short_term_investments, 0) + 0.75 * coalesce(accounts_receivable, 0) + 0.5 * coalesce(inventory, 0) - total_liabilities) / shares AS nn FROM ox_cur) y) x
"""


@query("ind3_ncav", "SELECT * FROM ox_i_ncav", r="value_bear value_base")
def ind3(u):
    return v.ncav(fundamentals(u), D.as_of()).select(*_ISEL)


standin.RELATIONS["ox_i_ps_value"] = """
SELECT c.ticker, na_reason IS NULL AS applicable, na_reason, CASE WHEN na_reason IS NULL THEN mid * p25 / median END AS value_bear, CASE WHEN na_reason IS NULL THEN mid END AS value_base, CASE WHEN na_reason IS NULL THEN mid * p75 / median END AS value_bull
FROM si_company c LEFT JOIN (SELECT s.*, i.mid, CASE WHEN s.n = 0 THEN 'no P/S range: nothing to rank' WHEN s.n < 36 THEN 'no P/S range: ' || 'only ' || s.n || ' of 36 months have a value' WHEN i.mid IS NULL AND s.current IS NULL THEN
   'no current P/S value: newest trailing year, to ' || latest_period_end || ', is ' || point_age || ' days back' END AS na_reason
  FROM ox_stats s JOIN ox_multiples m ON m.ticker = s.ticker AND m.date = s.date LEFT JOIN ox_implied i ON i.ticker = s.ticker AND i.date = s.date AND i.metric = 'ps'
  WHERE s.metric = 'ps' AND (s.ticker, s.date) IN (SELECT (ticker, max(date)) FROM ox_months GROUP BY ticker)) x ON x.ticker = c.ticker
"""


def ps_value(u):
    return v.ps_value(u.company, H.latest_ranges(u).where(F.col("metric") == "ps"))


@query("ind4_ps_value", "SELECT * FROM ox_i_ps_value", r="value_bear value_base value_bull")
def ind4(u):
    return ps_value(u).select(*_ISEL)


standin.RELATIONS["ox_i_graham_tangible"] = f"""
SELECT ticker, na_reason IS NULL AS applicable, na_reason, """ + ", ".join(f"CASE WHEN na_reason IS NULL THEN value_{n} * sqrt((total_equity - coalesce(goodwill, 0)) / total_equity) END AS value_{n}" for n in ("bear", "base", "bull")) + f"""
FROM (SELECT g.ticker, value_bear, value_base, value_bull, y.total_equity, y.goodwill, CASE WHEN NOT applicable THEN na_reason WHEN total_equity - coalesce(goodwill, 0) <= 0 THEN 'tangible book is negative: goodwill and intangibles exceed equity' END AS na_reason
 FROM ({D._at(D.GRAHAM_SQL)}) g LEFT JOIN ox_years y ON y.ticker = g.ticker AND y.fiscal_year = g.basis_fiscal_year) x
"""


def graham_tangible(u):
    book = u.annual.select("ticker", "fiscal_year", "total_equity", "goodwill", F.lit(None).cast("double").alias("intangible_assets"))
    return v.graham_tangible(D.inputs(u), book, D.as_of())


@query("ind5_graham_tangible", "SELECT * FROM ox_i_graham_tangible", r="value_bear value_base value_bull")
def ind5(u):
    return graham_tangible(u).select(*_ISEL)


_NAMES = ("reverse_dcf", "epv", "ncav", "ps_value", "graham_tangible")
standin.RELATIONS["ox_indicators"] = " UNION ALL ".join(f"SELECT '{n}' AS indicator, * FROM ox_i_{n}" for n in _NAMES)


def indicators(u):
    def build():
        out = reverse_dcf(u)
        for df in (epv(u), v.ncav(fundamentals(u), D.as_of()), ps_value(u), graham_tangible(u)):
            out = out.unionByName(df)
        return out
    return u.shared("indicators", build)


@query("ind6_indicators", "SELECT i.*, CASE WHEN indicator <> 'reverse_dcf' THEN (value_base - current_price) / current_price END AS upside FROM ox_indicators i JOIN ox_market m ON i.ticker = m.ticker", r="value_bear value_base value_bull upside")
def ind6(u):
    i = indicators(u).join(D.market(u).select("ticker", "current_price"), "ticker")
    return i.select("indicator", *_ISEL, F.when(F.col("indicator") != "reverse_dcf", v.upside(F.col("value_base"), F.col("current_price"))).alias("upside"))
