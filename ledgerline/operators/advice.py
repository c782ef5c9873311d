"""Advice, observations and labels that follow from a company's figures and from a range's width and confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds and texts of advice, observations and improvement actions, and the steps of a width's trust.
WIDTH_TRUST = ((5, 1.0), (7, 0.85), (9, 0.72), (11, 0.58), (13, 0.45), (15, 0.33), (17, 0.25))
WIDEST_TRUST = 0.12
OBSERVATIONS = (
    ("interest_coverage >= 3", "healthy debt servicing capacity"), ("debt_to_equity > 1.5", "elevated leverage pressure"), ("working_capital_days > 140", "stretched working capital cycle"),
    ("ebitda_margin_pct_pctile >= 0.75", "margins stronger than industry peers"), ("interest_coverage_pctile >= 0.75", "coverage stronger than peer set"), ("prior_agency_rank IS NOT NULL", "historical agency rating track record available"),
    ("promoter_delinquency_flag", "promoter bureau behavior indicates delinquency stress"), ("criminal_case_flag", "legal or criminal case information requires caution"), ("growth_plan_aggressive_flag", "five-year plan appears more aggressive than industry expectations"),
    ("plan_on_track_flag", "management plan execution appears on track"), ("scale_peer_cagr IS NOT NULL", "listed peers at similar scale provide a usable growth benchmark"),
    ("plan_gap > 5", "the submitted growth path looks aggressive versus listed peers at comparable scale"), ("public_risk_flag OR public_risk_score >= 4", "public-domain adverse-risk signals need careful manual review"), ("regulatory_risk_score >= 7", "regulatory risk appears elevated"),
)
NO_OBSERVATION = "limited signals outside the core financial profile"
ACTIONS = (
    ("debt_to_equity > 1.25", "Prioritize deleveraging and align new borrowing with visible cash generation."), ("interest_coverage < 2", "Improve operating cash generation or reduce finance cost to strengthen interest coverage."),
    ("working_capital_days > 120", "Tighten receivable collections and inventory discipline to improve working capital efficiency."), ("promoter_delinquency_flag", "Resolve promoter-level bureau delinquencies and maintain clean repayment conduct."),
    ("criminal_case_flag", "Address legal-governance issues proactively and strengthen disclosure around management integrity."), ("growth_plan_aggressive_flag", "Rebase the five-year business plan to more realistic industry growth assumptions and funding capacity."),
    ("plan_gap > 5", "Benchmark management projections against how listed peers historically grew from a similar revenue scale."),
    ("public_risk_flag OR public_risk_score >= 4", "Resolve or clarify public-domain adverse signals through legal, compliance, and disclosure documentation before approaching rating agencies."),
    ("plan_progress_score < 5", "Improve execution discipline against the stated business plan before pursuing a higher rating trajectory."),
)
NO_ACTION = "Maintain current leverage, coverage, and liquidity discipline while improving disclosure depth."
ADVICE = (
    ("coalesce(receivables_days, 0) > 120", "Receivable days are elevated; improve collections and tighten working-capital controls."), ("coalesce(debt_to_equity, 0) > 2.0", "Leverage appears high; evaluate deleveraging and debt-structure optimization."),
    ("coalesce(ebitda_margin_pct, 0) < 10.0", "Margins are thin; focus on pricing discipline, mix improvement, and cost control."), ("NOT rated", "No external rating found; manual credit underwriting and internal simulation should be prioritized."),
    ("method = 'model'", "TReDS capacity is estimated from financial proxies; validate with banker or platform data before use."),
)


def told(rules: tuple[tuple[str, str], ...], default: str | None = None) -> Column:
    """The texts of all rules that hold, in their order; the default alone if none does."""
    texts = F.array_compact(F.array(*(F.when(F.expr(rule), text) for rule, text in rules)))
    return texts if default is None else F.when(F.size(texts) == 0, F.array(F.lit(default))).otherwise(texts)


def rationale(company: Column, rating: Column, agency: Column, observations: Column) -> Column:
    """One sentence on a simulated rating, and one on its three first observations."""
    return F.concat(company, F.lit(" is simulated at "), F.coalesce(F.nullif(rating, F.lit("")), F.lit("an estimated rating")), F.lit(" under the "), agency, F.lit(" lens. The result is driven by "), F.array_join(F.slice(observations, 1, 3), ", "), F.lit("."))


def width_trust(width: Column) -> Column:
    steps = F.when(width <= WIDTH_TRUST[0][0], WIDTH_TRUST[0][1])
    for most, trust in WIDTH_TRUST[1:]:
        steps = steps.when(width <= most, trust)
    return steps.otherwise(WIDEST_TRUST)


def usability(width: Column, confidence: Column) -> Column:
    return F.when((width <= 5) & (confidence >= 0.55), "focused").when((width <= 11) & (confidence >= 0.4), "workable").otherwise("directional_only")


def actionability(usable: Column, confidence: Column, history: Column) -> Column:
    return F.when(usable == "manual_review_required", usable).when((usable == "focused") & (confidence >= 0.6) & history, "high").when(usable.isin("focused", "workable") & (confidence >= 0.45), "medium").otherwise("low")


def review_priority(usable: Column, confidence: Column, history: Column) -> Column:
    return F.when(usable.isin("directional_only", "manual_review_required") | (confidence < 0.4), "high").when(~history | (confidence < 0.55), "medium").otherwise("low")


def selection_priority(confidence: Column, trust: Column, strength: Column, history: Column) -> Column:
    score = (confidence * 0.5 + trust * 0.25 + strength * 0.25) * F.when(history, 1.0).otherwise(0.7)
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))
