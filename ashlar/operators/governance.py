"""Roles, usage tags and policy violations of repositories, from the columns of their profiles.

A profile may lack any of the columns: what is missing does not hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Technologies of user interfaces.
UI_TECHNOLOGIES = ("React", "Angular")
#: Usage tags, and the profile's column that each stands for; a list stands for being not empty.
TAGS = {
    "embeddings": "embeddings_vector_db", "prompt": "prompt_handling", "serving": "model_serving", "agent": "agent_tool_use", "iac": "has_iac", "api": "has_api_surface", "ci": "ci_systems",
    "branch_governance": "has_branch_governance", "review_gate": "has_review_gate", "missing_governance": "missing_governance", "orphaned": "is_orphaned", "runtime_drift": "drift_labels",
    "shared_internal_libs": "shared_internal_libs", "dependency_risk": "dependency_risk", "ai_drift_risk": "ai_drift_risk", "risky": "risky_repo", "orphaned_risky": "orphaned_risky",
    "policy_violation": "policy_violations", "import_cycle": "has_import_cycles", "anti_pattern": "anti_pattern_labels", "overlap_risk": "has_overlap_risk", "inbound_dependency_risk": "inbound_dependency_risk",
    "outbound_dependency_risk": "outbound_dependency_risk", "critical_infrastructure": "critical_infrastructure_risk", "hidden_coupling": "has_hidden_coupling",
}
#: Rules of governance by name and wording.
VIOLATIONS = {
    "api_without_security_policy": "A repository with an API needs a SECURITY.md",
    "iac_without_ci": "Infrastructure as code needs continuous integration",
    "ai_without_governance": "A repository that uses models needs the governance files",
    "risky_without_owner": "A risky repository needs an owner",
    "heavy_dependencies": "Weak governance does not go with many external dependencies",
}


def holds(df: DataFrame, name: str) -> Column:
    """A boolean column, or whether a list column is not empty; false where it is null or missing."""
    if name not in df.columns:
        return F.lit(False)
    kind = dict(df.dtypes)[name]
    value = F.size(name) > 0 if kind.startswith("array") else F.col(name) != "" if kind == "string" else F.col(name)
    return F.coalesce(value.cast("boolean"), F.lit(False))


def service_role(df: DataFrame, ui: tuple[str, ...] = UI_TECHNOLOGIES) -> Column:
    """ui by technology, else api, else worker (topics or event systems), else platform, else service."""
    shown = F.coalesce(F.arrays_overlap("technologies", F.array(*[F.lit(t) for t in ui])), F.lit(False)) if "technologies" in df.columns else F.lit(False)
    works = holds(df, "produced_topics") | holds(df, "consumed_topics") | holds(df, "event_systems")
    return F.when(shown, "ui").when(holds(df, "has_api_surface"), "api").when(works, "worker").when(holds(df, "has_iac"), "platform").otherwise("service")


def violations(df: DataFrame) -> Column:
    """Names of the rules of ``VIOLATIONS`` that a repository breaks, in their order."""
    missing = F.coalesce(F.col("missing_governance"), F.array().cast("array<string>")) if "missing_governance" in df.columns else F.array().cast("array<string>")
    uses = holds(df, "embeddings_vector_db") | holds(df, "prompt_handling") | holds(df, "model_serving") | holds(df, "agent_tool_use") | holds(df, "ai_usage")
    broken = {
        "api_without_security_policy": holds(df, "has_api_surface") & F.array_contains(missing, "SECURITY.md"), "iac_without_ci": holds(df, "has_iac") & ~holds(df, "ci_systems"),
        "ai_without_governance": uses & (F.size(missing) > 0), "risky_without_owner": holds(df, "orphaned_risky"), "heavy_dependencies": holds(df, "dependency_risk"),
    }
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in broken.items()]))


def usage_tags(df: DataFrame, tags: dict[str, str] = TAGS) -> Column:
    """Sorted tags of what holds for a repository."""
    return F.array_sort(F.array_compact(F.array(*[F.when(holds(df, c), F.lit(t)) for t, c in tags.items()])))


def governed(profiles: DataFrame, inbound: DataFrame | None = None) -> DataFrame:
    """``profiles`` (repo and more) with role, policy_violations and usage_tags.

    ``inbound`` (repo, in_degree, out_degree) marks repositories on which two or more depend, that
    depend on two or more, and those of three or more edges as critical.
    """
    rows = profiles
    if inbound is not None:
        n = lambda c: F.coalesce(F.col(c), F.lit(0))
        rows = rows.join(inbound.select("repo", "in_degree", "out_degree"), "repo", "left")
        rows = rows.withColumns({"inbound_dependency_risk": n("in_degree") >= 2, "outbound_dependency_risk": n("out_degree") >= 2, "critical_infrastructure_risk": n("in_degree") + n("out_degree") >= 3})
    rows = rows.withColumns({"role": service_role(rows), "policy_violations": violations(rows)})
    return rows.withColumn("usage_tags", usage_tags(rows))
