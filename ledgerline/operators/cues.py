"""Derived columns of the training set, and the cues that explain a scored row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import order_stats

# Cues of high values (good ones first), of signals and of trends, in the order they are told.
GOOD_HIGH = {"ebitda_margin_pct": "healthy EBITDA margins", "interest_coverage": "strong interest coverage", "cash_to_borrowings": "cash buffers support debt service", "asset_turnover": "healthy asset turnover"}
BAD_HIGH = {"debt_to_equity": "elevated leverage", "working_capital_days": "stretched working capital cycle", "receivables_days": "high receivable days", "inventory_days": "high inventory holding"}
SIGNAL_CUES = {
    "has_management_strength": "management strength", "has_group_support": "group support", "has_scale_constraint": "scale constraint", "has_working_capital_pressure": "working capital pressure",
    "has_liquidity_adequate": "adequate liquidity", "has_liquidity_stretched": "stretched liquidity", "has_regulatory_risk": "regulatory risk", "has_fx_risk": "foreign exchange risk",
    "has_customer_concentration": "customer concentration", "has_product_diversification": "product diversification", "has_export_risk": "export risk", "has_capex_risk": "capex risk",
    "has_margin_pressure": "margin pressure", "has_leverage_improvement": "leverage improvement", "has_turnaround_story": "turnaround story", "has_non_cooperation_flag": "non-cooperation flag",
    "has_contingent_liability_risk": "contingent liability risk", "has_msa_dependency": "MSA dependency", "has_capacity_expansion": "capacity expansion", "has_niche_complex_portfolio": "niche portfolio",
    "has_strong_roce": "strong ROCE", "has_net_cash_position": "net cash position",
}
TREND_CUES = {
    "profitability_trend_positive": "profitability improving", "leverage_trend_improving": "leverage improving", "coverage_trend_improving": "coverage improving", "working_capital_trend_improving": "working capital cycle improving",
}
#: (column, rule, text); a cue whose column the rows don't hold isn't told.
LATE_CUES = (
    ("depth", "depth >= 3", "multi-year financial history available"), ("prior_agency_rank", "prior_agency_rank > 0", "past agency rating available"), ("interest_coverage_pctile", "interest_coverage_pctile >= 0.75", "coverage stronger than industry median"),
    ("ebitda_margin_pct_pctile", "ebitda_margin_pct_pctile >= 0.75", "margins stronger than industry peers"), ("working_capital_days_pctile", "working_capital_days_pctile >= 0.75", "working capital weaker than industry peers"),
    ("scale_peer_cagr", "scale_peer_cagr > 0", "listed peer trajectories available at similar scale"), ("plan_gap", "plan_gap > 5", "projected growth exceeds listed peer trajectories"), ("promoter_delinquency_flag", "promoter_delinquency_flag", "promoter bureau stress"),
    ("criminal_case_flag", "criminal_case_flag", "legal or criminal case flag"), ("public_risk_flag", "public_risk_flag OR public_risk_score >= 4", "public-domain risk signals detected"), ("growth_plan_aggressive_flag", "growth_plan_aggressive_flag", "growth plan appears aggressive"),
    ("plan_on_track_flag", "plan_on_track_flag", "management plan execution on track"),
)
NO_CUE = "financial profile only; limited rationale coverage"
AGGRESSIVE_GAP = 5.0


def trends() -> dict[str, Column]:
    """Whether the three-year slopes speak for a company; unknown slopes do not."""
    rising = lambda m: F.coalesce(F.col(f"{m}_slope3y") > 0, F.lit(False))
    falling = lambda m: F.coalesce(F.col(f"{m}_slope3y") < 0, F.lit(False))
    return {"profitability_trend_positive": rising("ebitda_margin_pct"), "leverage_trend_improving": falling("debt_to_equity"), "coverage_trend_improving": rising("interest_coverage"), "working_capital_trend_improving": falling("working_capital_days"), "scale_growth_positive": rising("revenue_crore")}


def plan_gaps(plan: Column, peers: Column) -> dict[str, Column]:
    """A plan's growth over its peers', how aggressive that is, whether it is too much, and whether it keeps to the peers'; null or false without both."""
    gap = plan - peers
    return {"plan_gap": gap, "plan_aggressiveness": F.greatest(F.lit(0.0), gap), "growth_plan_aggressive_flag": F.coalesce(gap > AGGRESSIVE_GAP, F.lit(False)), "plan_on_track_flag": F.coalesce(gap.between(-AGGRESSIVE_GAP, 0), F.lit(False))}


def quartiles(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """One row with the upper quartile of each metric, `<metric>_q75`."""
    ranked = order_stats.ranked_values(order_stats.melted(rows, [], metrics), ["metric"])
    return order_stats.wide(order_stats.quantiles(ranked, ["metric"], {"q75": 0.75}), metrics, "q75")


def key_features(rows: DataFrame, n: int = 5) -> DataFrame:
    """rows with `key_features`, the first n cues in their fixed order; a row without any says so."""
    have = set(rows.columns)
    high = {m: text for m, text in (GOOD_HIGH | BAD_HIGH).items() if m in have}
    known = rows.crossJoin(F.broadcast(quartiles(rows, list(high))))
    told = [F.when(F.col(m) >= F.col(f"{m}_q75"), text) for m, text in high.items()]
    told += [F.when(F.col(s), text) for s, text in SIGNAL_CUES.items() if s in have]
    told += [F.concat(F.lit("liquidity: "), F.col("liquidity_label"))] if "liquidity_label" in have else []
    told += [F.lower("scope")] if "scope" in have else []
    told += [F.when(F.col(t), text) for t, text in TREND_CUES.items() if t in have]
    told += [F.when(F.expr(rule), text) for column, rule, text in LATE_CUES if column in have]
    cues = F.array_compact(F.array(*told))
    return known.withColumn("key_features", F.when(F.size(cues) == 0, F.array(F.lit(NO_CUE))).otherwise(F.slice(cues, 1, n))).drop(*(f"{m}_q75" for m in high))
