"""The batch job (VAL-21): every result table from the stored ones, each computed once and written once."""

from __future__ import annotations

from pyspark.sql import DataFrame

from finstrata.operators import valuation as v
from finstrata.plans.catalog import c_history, d_valuation, e_scores
from finstrata.plans.standin import Universe


def compute_all(u: Universe) -> dict[str, DataFrame]:
    """Result tables in dependency order: history before scores, scores before indicators, ranks last."""
    models = d_valuation.results(u)
    return {
        "valuations": models, "valuation_summary": v.intrinsic_summary(models), "valuation_history": c_history.monthly(u),
        "valuation_ranges": c_history.latest_ranges(u), "quality_scores": e_scores.scores(u), "warning_signs": e_scores.signs(u),
        "valuation_indicators": e_scores.indicators(u), "per_share_annual": e_scores.rows(u),
        "ranks": u.shared("ranks", lambda: e_scores.rk.rank_all(e_scores.stable(u), e_scores.scores(u), u.company)),
    }


def store_all(tables: dict[str, DataFrame], root: str) -> None:
    """Writes each table under a new *root*."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{root.rstrip('/')}/{name}")
