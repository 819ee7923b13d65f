"""Severity, policy, confidence and signal expressions over finding columns.

Expected columns (all by name): severity int, category, rule, context, policy_status,
snippet, match, capability, file, confidence int, corroboration int.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clamp

#: Evidence weights in log-odds (fixed values), and the prior.
PRIOR = 0.35
WEIGHTS = {
    "import_guard": 1.20, "direct_assignment": 0.90, "call_site": 0.70, "security": 0.65, "entropy_key": 0.85, "config_native": 0.40,
    "notebook": 0.20, "corroborated": 0.60, "well_corroborated": 0.90, "long_match": 0.30, "test": -1.40, "history": -0.40, "docs": -0.80, "very_short": -0.40,
}
LABELS = {1: "Critical", 2: "High", 3: "Medium", 4: "Low"}
#: Rules that stay critical in any context (fixed values; a parameter in the functions).
ALWAYS_CRITICAL = ("hardcoded_key", "openai_key_pattern", "anthropic_key_pattern", "hardcoded_credential", "aws_access_key", "unsafe_code_exec", "unsafe_pickle_model")


def confidence(signals: dict[str, Column]) -> Column:
    """Calibrated confidence of 5 to 98: the logistic of the prior's log-odds and
    the weights of the signals that hold."""
    total = F.lit(math.log(PRIOR / (1.0 - PRIOR)))
    for name, holds in signals.items():
        total = total + F.when(holds, F.lit(WEIGHTS[name])).otherwise(F.lit(0.0))
    return clamp(F.bround(F.lit(100.0) / (F.lit(1.0) + F.exp(-total)), 0).cast("int"), 5, 98)


def risk_label(severity: Column) -> Column:
    out = F.lit("Low")
    for level in (3, 2, 1):
        out = F.when(severity == level, F.lit(LABELS[level])).otherwise(out)
    return out


def severity_label(severity: Column) -> Column:
    return F.concat(F.lit("Sev-"), severity.cast("string"), F.lit(" ("), risk_label(severity), F.lit(")"))


def bumped(base: Column, bump: Column) -> Column:
    return clamp(base + bump, 1, 4)


def context_bump(context: Column) -> Column:
    return F.when(context.isin("test", "docs"), 2).otherwise(0)


def policy(always: tuple[str, ...] = ALWAYS_CRITICAL) -> tuple[Column, Column]:
    """Policy status and severity. ``policy_list`` (approved, restricted, banned
    or null) comes from a join with the policy table."""
    rule, cat, ctx, sev, listed = (F.col(c) for c in ("rule", "category", "context", "severity", "policy_list"))
    secure = cat == "Security"
    prod = ctx == "production"
    given = F.coalesce(F.col("policy_status"), F.lit(""))
    status = (
        F.when(rule.isin(*always), F.lit("CRITICAL")).when(secure & ~prod, F.lit("REVIEW")).when(secure, F.lit("CRITICAL"))
        .when(listed == "banned", F.lit("BANNED")).when(listed == "restricted", F.lit("RESTRICTED")).when(listed == "approved", F.lit("APPROVED"))
        .when(given.isin("CRITICAL", "DENIED", "ALLOWED"), given).otherwise(F.lit("REVIEW"))
    )
    severity = (
        F.when(rule.isin(*always), F.lit(1)).when(secure & ~prod, F.greatest(sev, F.lit(3))).when(secure, F.lit(1))
        .when(listed == "banned", F.least(sev, F.lit(1))).when(listed == "restricted", F.least(sev, F.lit(2))).when(listed == "approved", F.least(sev + 1, F.lit(4))).otherwise(sev)
    )
    return status, severity


def allow_deny(match: Column, secure: Column, allow: list[str], deny: list[str]) -> Column:
    """DENIED, then ALLOWED, then CRITICAL for security rules, else REVIEW."""
    hit = lambda patterns: F.exists(F.array(*[F.lit(p) for p in patterns]), lambda p: F.regexp(match, p)) if patterns else F.lit(False)
    return F.when(hit(deny), F.lit("DENIED")).when(hit(allow), F.lit("ALLOWED")).when(secure, F.lit("CRITICAL")).otherwise(F.lit("REVIEW"))


def production_relevance() -> Column:
    ctx, sev = F.col("context"), F.col("severity")
    base = F.when(ctx == "production", 85).when(ctx == "docs", 15).when(ctx == "test", 30).when(ctx == "deleted_file", 10).otherwise(50)
    add = F.when(sev == 1, 12).when(sev == 2, 8).when(sev == 3, 3).otherwise(0)
    held = F.when(F.col("policy_status").isin("CRITICAL", "BANNED", "RESTRICTED"), 6).otherwise(0)
    doc = F.when(F.lower("file").rlike(r"\.(md|mdx|rst|txt|adoc)$"), 15).otherwise(0)
    return clamp(base + add + held - doc, 0, 100)


def evidence_quality(always: tuple[str, ...] = ALWAYS_CRITICAL) -> Column:
    snip, match = F.trim(F.coalesce("snippet", F.lit(""))), F.trim(F.coalesce("match", F.lit("")))
    shown = F.when(snip == "", -6).when(snip == "(source not available)", -10).otherwise(18 + F.when(F.length(snip) >= 80, 8).otherwise(0))
    hit = F.when(match == "", 0).otherwise(12 + F.when(F.length(match) >= 16, 5).otherwise(0))
    capable = F.when(F.trim(F.coalesce("capability", F.lit(""))) != "", 4).otherwise(0)
    both = F.when(F.coalesce("corroboration", F.lit(0)) >= 3, 10).otherwise(0)
    critical = F.when(F.col("rule").isin(*always), 14).otherwise(0)
    other = F.when(F.col("context") != "production", 10).otherwise(0)
    return clamp(F.lit(35) + shown + hit + capable + both + critical - other, 0, 100)


def overall_signal(detector: Column, production: Column, evidence: Column, review: Column | None = None) -> Column:
    score = F.bround(detector * 0.4 + production * 0.35 + evidence * 0.25, 0)
    if review is not None:
        score = F.when(review.isNotNull(), F.bround(score * 0.8 + review * 0.2, 0)).otherwise(score)
    return clamp(score.cast("int"), 0, 100)


def risk_score(critical: Column, high: Column, medium: Column, low: Column, critical_prod: Column, high_prod: Column) -> Column:
    return critical * 10 + high * 5 + medium * 2 + low + critical_prod * 4 + high_prod * 2
