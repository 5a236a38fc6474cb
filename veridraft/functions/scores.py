"""Scores, bands, ranks and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veridraft import domains as D
from veridraft.functions.columns import mapped, or_default, truthy


def risk_band(score: Column) -> Column:
    """A16. Band of a score; NULL scores have no band."""
    return (
        F.when(score >= D.TRUSTWORTHY_FROM, D.BAND_TRUSTWORTHY)
        .when(score >= D.REVIEW_FROM, D.BAND_REVIEW)
        .when(score.isNotNull(), D.BAND_HIGH_RISK)
    )


def clamp_score(score: Column) -> Column:
    """A17. Score held inside 0..100; NULL shows as 0."""
    # least/greatest skip NULL, so it is handled first
    return F.when(score.isNull(), 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), score)))


def effective_score(status: Column, trust: Column, reviewed: Column) -> Column:
    """A18. Nothing while processing, else the reviewed score, else the trust score."""
    return F.when(status.isNull() | (status != "PROCESSING"), F.coalesce(reviewed, trust))


def severity_rank(severity: Column) -> Column:
    """A19. 0 = worst; anything unknown sorts last."""
    return F.coalesce(mapped(severity, D.SEVERITY_RANK), F.lit(D.UNKNOWN_RANK))


def severity_of_rank(rank: Column) -> Column:
    return mapped(rank, {v: k for k, v in D.SEVERITY_RANK.items()})


def infer_verdict(verdict: Column, severity: Column) -> Column:
    """A20. The stated verdict, else one implied by severity."""
    return F.coalesce(
        truthy(verdict),
        F.when(severity.isin("CRITICAL", "HIGH"), "CONTRADICTED")
        .when(severity == "MEDIUM", "UNSUPPORTED")
        .otherwise("UNCERTAIN"),
    )


def score_state(status: Column) -> Column:
    """A21. State the workspace passes to the score ring."""
    return F.when(status == "PROCESSING", "calculating").otherwise("available")


def resolved_state(explicit: Column, score: Column) -> Column:
    """A21. Without an explicit state a missing score means it is still calculated."""
    return or_default(explicit, F.when(score.isNull(), "calculating").otherwise("available"))


def score_label(state: Column, score: Column) -> Column:
    """A21. Text under the score."""
    return F.coalesce(mapped(state, D.LABELS["score_state"]), risk_band(clamp_score(score)))


def label_of(value: Column, domain: str) -> Column:
    """A22. Display label; see ``domains.LABELS`` for the domains."""
    return mapped(value, D.LABELS[domain])


def materiality_label(value: Column) -> Column:
    """A22. Only MATERIAL has a longer label."""
    return F.when(value == "MATERIAL", "MATERIAL RISK").otherwise(value)


def progress_percent(status: Column) -> Column:
    """A23."""
    return F.when(status.isin(*D.DONE_AUDIT_STATUSES), 100).otherwise(75)


def current_stage(status: Column) -> Column:
    """A23."""
    return F.when(status == "REVIEW REQUIRED", D.STAGE_AWAITING).otherwise(D.STAGE_DONE)


def materiality_tier(word: Column) -> Column:
    """A29."""
    return (
        F.when(word.isin(*D.RED_MATERIALITY), "red")
        .when(word.isin(*D.AMBER_MATERIALITY), "amber")
        .otherwise("slate")
    )


def policy_tier(status: Column) -> Column:
    """A29."""
    return label_of(status, "policy_tier")


def findings_label(count: Column) -> Column:
    """A47."""
    return F.when(count > 0, F.concat(count.cast("string"), F.lit(" findings"))).otherwise("0")


def decision_feedback(action: Column) -> Column:
    """A68."""
    return label_of(action, "feedback")
