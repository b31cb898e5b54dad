"""Financial ratios of one period row (RAT-1..22), all as column expressions.

Each ratio reads canonical line items of the same row, so the whole suite is one projection that
stays inside a single generated stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finstrata.functions.exprs import clamp, over_positive, sum_present, zero_if_null

# The default tax rate and its upper bound for operating profit after tax.
DEFAULT_TAX = 0.21
TAX_CEILING = 0.5
DAYS_IN_YEAR = 365.0

# The ratios that mean nothing for a sector.
SUPPRESSED = {
    "bank": ("ebitda ebit ebitda_margin debt_to_ebitda roic nopat invested_capital interest_coverage gross_margin "
             "operating_margin inventory_turnover days_inventory_outstanding receivables_turnover "
             "days_sales_outstanding asset_turnover working_capital net_debt total_debt free_cash_flow fcf_margin "
             "levered_fcf enterprise_value ev_to_ebitda ev_to_revenue ev_to_fcf fcf_yield").split(),
    "insurance": ("ebitda ebitda_margin debt_to_ebitda ev_to_ebitda roic nopat invested_capital inventory_turnover "
                  "days_inventory_outstanding gross_margin asset_turnover working_capital").split(),
    "reit": ("roic nopat invested_capital inventory_turnover days_inventory_outstanding receivables_turnover "
             "days_sales_outstanding gross_margin asset_turnover free_cash_flow fcf_margin levered_fcf ev_to_fcf "
             "fcf_yield").split(),
}
# The notes on ratios that approximate.
BASIS = {
    "net_interest_margin": "proxy: net_interest_income / total_assets (no earning-assets line)",
    "combined_ratio": "proxy: benefits_and_expenses / premiums_earned (no separate underwriting expense)",
    "ffo": "proxy: net_income + total D&A (not RE-specific; no gains-on-sale adjustment)",
    "affo": "proxy: ffo - total capex (not maintenance capex)",
}
GENERIC = ("ebitda ebit nopat free_cash_flow fcf_margin levered_fcf net_debt total_debt working_capital "
           "invested_capital roic roa roe interest_coverage debt_to_ebitda asset_turnover inventory_turnover "
           "receivables_turnover days_sales_outstanding days_inventory_outstanding gross_margin operating_margin "
           "net_margin ebitda_margin").split()
MARKET = "enterprise_value ev_to_ebitda ev_to_revenue ev_to_fcf fcf_yield".split()
SECTOR = {
    "bank": "net_interest_margin efficiency_ratio loan_to_deposit".split(),
    "insurance": "loss_ratio combined_ratio".split(),
    "reit": "ffo affo ffo_per_share ffo_payout".split(),
}
ALL_RATIOS = GENERIC + MARKET + [m for ms in SECTOR.values() for m in ms]


class Items:
    """Line items by attribute; one the DataFrame lacks reads as a NULL double."""

    def __init__(self, df: DataFrame):
        self._have = set(df.columns)

    def __getattr__(self, name: str) -> Column:
        return F.col(name) if name in self._have else F.lit(None).cast("double")


def ebitda(x: Items, vendor: Column | None = None) -> Column:
    from_operations = x.operating_income + x.depreciation_amortization
    from_income = (x.net_income + x.depreciation_amortization + zero_if_null(x.interest_expense)
                   + zero_if_null(x.income_tax_expense))
    options = [from_operations, from_income]
    if vendor is not None:
        options.append(F.nullif(vendor, F.lit(0.0)))
    return F.coalesce(*options)


def nopat(x: Items) -> Column:
    effective = F.when((x.pretax_income > 0) & (x.income_tax_expense != 0),
                       clamp(x.income_tax_expense / F.nullif(x.pretax_income, F.lit(0.0)), 0.0, TAX_CEILING))
    return x.operating_income * (1 - F.coalesce(effective, F.lit(DEFAULT_TAX)))


def free_cash_flow(x: Items) -> Column:
    return x.operating_cash_flow - zero_if_null(F.abs(x.capex))


def total_debt(x: Items) -> Column:
    return sum_present(x.long_term_debt, x.short_term_debt, x.commercial_paper)


def net_debt(x: Items) -> Column:
    return total_debt(x) - (zero_if_null(x.cash_and_equivalents) + zero_if_null(x.short_term_investments))


def invested_capital(x: Items) -> Column:
    capital = x.total_equity + total_debt(x) - zero_if_null(x.cash_and_equivalents)
    return F.when(capital > 0, capital)


def gross_margin(x: Items) -> Column:
    return over_positive(F.coalesce(x.gross_profit, x.revenue - x.cost_of_revenue), x.revenue)


def funds_from_operations(x: Items) -> Column:
    return x.net_income + x.depreciation_amortization


def ratio_columns(df: DataFrame, market_cap: Column | None = None,
                  vendor_ebitda: Column | None = None) -> dict[str, Column]:
    """Every ratio before the sector overlay, as columns over *df*'s line items."""
    x = Items(df)
    e, fcf, debt, cap = ebitda(x, vendor_ebitda), free_cash_flow(x), total_debt(x), invested_capital(x)
    receivables = over_positive(x.revenue, x.accounts_receivable)
    inventory = over_positive(x.cost_of_revenue, x.inventory)
    out = {
        "ebitda": e,
        "ebit": x.operating_income,
        "nopat": nopat(x),
        "free_cash_flow": fcf,
        "fcf_margin": over_positive(fcf, x.revenue),
        "levered_fcf": fcf,
        "net_debt": net_debt(x),
        "total_debt": debt,
        "working_capital": x.current_assets - x.current_liabilities,
        "invested_capital": cap,
        "roic": over_positive(nopat(x), cap),
        "roa": over_positive(x.net_income, x.total_assets),
        "roe": over_positive(x.net_income, x.total_equity),
        "interest_coverage": over_positive(x.operating_income, x.interest_expense),
        "debt_to_ebitda": over_positive(debt, e),
        "asset_turnover": over_positive(x.revenue, x.total_assets),
        "inventory_turnover": inventory,
        "receivables_turnover": receivables,
        "days_sales_outstanding": over_positive(F.lit(DAYS_IN_YEAR), receivables),
        "days_inventory_outstanding": over_positive(F.lit(DAYS_IN_YEAR), inventory),
        "gross_margin": gross_margin(x),
        "operating_margin": over_positive(x.operating_income, x.revenue),
        "net_margin": over_positive(x.net_income, x.revenue),
        "ebitda_margin": over_positive(e, x.revenue),
    }
    if market_cap is not None:
        ev = market_cap + zero_if_null(net_debt(x))
        out.update({
            "enterprise_value": ev,
            "ev_to_ebitda": over_positive(ev, e),
            "ev_to_revenue": over_positive(ev, x.revenue),
            "ev_to_fcf": over_positive(ev, fcf),
            "fcf_yield": over_positive(fcf, market_cap),
        })
    return out


def sector_columns(df: DataFrame) -> dict[str, Column]:
    """The ratios of banks, insurers and REITs, not yet limited to those sectors."""
    x = Items(df)
    ffo = funds_from_operations(x)
    return {
        "net_interest_margin": over_positive(x.net_interest_income, x.total_assets),
        "efficiency_ratio": over_positive(x.noninterest_expense, x.net_interest_income + x.noninterest_income),
        "loan_to_deposit": over_positive(x.total_loans, x.total_deposits),
        "loss_ratio": over_positive(x.claims_incurred, x.premiums_earned),
        "combined_ratio": over_positive(x.benefits_and_expenses, x.premiums_earned),
        "ffo": ffo,
        "affo": ffo - x.capex,
        "ffo_per_share": over_positive(ffo, x.weighted_avg_shares_diluted),
        "ffo_payout": over_positive(x.dividends_paid, ffo),
    }


def ratios(period: DataFrame, sector_col: str | None = "sector_class", market_cap: Column | None = None,
           vendor_ebitda: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """All ratios of each period row. Without a sector column the generic suite is unchanged.

    ``basis`` maps each approximated ratio that has a value to its note.
    """
    cols = ratio_columns(period, market_cap, vendor_ebitda)
    kept = [F.col(c) for c in (keep if keep is not None else period.columns)]
    if sector_col is None:
        return period.select(*kept, *[c.alias(n) for n, c in cols.items()])
    sector = F.col(sector_col)
    out: dict[str, Column] = {}
    for name, c in cols.items():
        off = [s for s, names in SUPPRESSED.items() if name in names]
        out[name] = F.when(sector.isin(off), None).otherwise(c) if off else c
    extra = sector_columns(period)
    for s, names in SECTOR.items():
        for name in names:
            out[name] = F.when(sector == s, extra[name])
    notes = F.map_from_entries(F.array_compact(F.array(*[
        F.when(out[m].isNotNull(), F.struct(F.lit(m).alias("k"), F.lit(t).alias("v"))) for m, t in BASIS.items()])))
    return period.select(*kept, *[c.alias(n) for n, c in out.items()], notes.alias("basis"))
