"""Findings across scans, and trends over the scan history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scoring import risk_score


def rollup(findings: DataFrame, triage: DataFrame, order: list[str]) -> DataFrame:
    """One row a finding hash over all scans: first and last seen, scans, the
    attributes of its latest row, and its status."""
    rank = F.struct(*order)
    got = findings.groupBy("hash").agg(
        F.min("started_at").alias("first_seen"), F.max("started_at").alias("last_seen"), F.count_distinct("scan_id").alias("scan_count"),
        F.min_by("repo", rank).alias("repo"), F.min_by("rule", rank).alias("rule"), F.max_by("file", rank).alias("file"), F.max_by("severity", rank).alias("severity"),
    )
    return got.join(triage, "hash", "left").withColumn("status", F.coalesce("status", F.lit("open")))


def last_scan_of_repo(scans: DataFrame, n: int = 1) -> DataFrame:
    """The n-th latest scan of each (project, repo), as of any later scan. Tasks
    keep the n latest of each repo before rows are sent."""
    latest = W.partitionBy("project_key", "repo").orderBy(F.desc("started_at"), F.desc("scan_id"))
    rows = scans.select("project_key", "repo", "scan_id", "started_at").withColumn("__n", F.row_number().over(latest)).filter(F.col("__n") <= n)
    return rows.filter(F.col("__n") == n).drop("__n")


def latest_two(scans: DataFrame) -> DataFrame:
    """The latest and the previous scan of each repo. Two maxima: a repo of many
    scans is no large window partition."""
    key = F.struct("started_at", "scan_id")
    last = scans.groupBy("repo").agg(F.max(key).alias("last"))
    before = scans.join(last, "repo").filter(key < F.col("last")).groupBy("repo").agg(F.max(key).alias("previous"))
    got = last.join(before, "repo", "left")
    return got.select("repo", F.col("last.scan_id").alias("latest_id"), F.col("last.started_at").alias("latest_at"), F.col("previous.scan_id").alias("previous_id"), F.col("previous.started_at").alias("previous_at"))


def scan_measures(findings: DataFrame) -> DataFrame:
    """Severity counts and risk of each scan."""
    sev, prod = F.col("severity"), F.col("context") == "production"
    got = findings.groupBy("scan_id", "repo").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(sev == 1).alias("critical"), F.count_if(sev == 2).alias("high"), F.count_if(sev == 3).alias("medium"), F.count_if(sev == 4).alias("low"),
        F.count_if((sev == 1) & prod).alias("critical_prod"), F.count_if((sev == 2) & prod).alias("high_prod"),
    )
    return got.withColumn("risk", risk_score(*[F.col(c) for c in ("critical", "high", "medium", "low", "critical_prod", "high_prod")]))


def repo_risk(measures: DataFrame, scans: DataFrame) -> DataFrame:
    """Scans of each repo and the risk of its latest."""
    joined = measures.join(scans.select("scan_id", "started_at"), "scan_id")
    rank = F.struct("started_at", "scan_id")
    return joined.groupBy("repo").agg(F.count(F.lit(1)).alias("scan_count"), F.max_by("risk", rank).alias("risk"), F.max_by("critical_prod", rank).alias("critical_prod"))


def rule_counters(findings: DataFrame, triage: DataFrame) -> DataFrame:
    """Active and suppressed findings of each rule, and the suppression rate."""
    joined = findings.join(triage, "hash", "left")
    fp = F.coalesce(F.col("status") == "false_positive", F.lit(False))
    got = joined.groupBy("rule").agg(F.count_if(~fp).alias("active"), F.count_if(fp).alias("suppressed"))
    total = F.col("active") + F.col("suppressed")
    return got.withColumn("rate", F.when(total > 0, F.bround(F.col("suppressed") * 100.0 / total, 0).cast("int")))


def model_failures(scans: DataFrame) -> DataFrame:
    name = F.coalesce(F.nullif(F.trim("llm_model"), F.lit("")), F.lit("Unavailable"))
    got = scans.groupBy(name.alias("llm_model")).agg(F.count(F.lit(1)).alias("scans"), F.count_if(F.col("state") == "error").alias("failed"))
    return got.withColumn("failure_pct", F.bround(F.col("failed") * 100.0 / F.col("scans"), 0).cast("int"))


def new_and_fixed(findings: DataFrame, scans: DataFrame) -> DataFrame:
    """For each scan of a repo the findings that its previous scan did not have,
    and those of the previous that it does not have."""
    in_order = W.partitionBy("repo").orderBy("started_at", "scan_id")
    steps = scans.select("repo", "scan_id", F.lag("scan_id").over(in_order).alias("previous_id"))
    seen = findings.select("scan_id", "hash").distinct()
    now = steps.join(seen, "scan_id")
    then = steps.filter("previous_id is not null").join(seen.withColumnRenamed("scan_id", "previous_id"), "previous_id").select("scan_id", "hash").withColumn("had", F.lit(1))
    both = now.select("scan_id", "hash").withColumn("has", F.lit(1)).join(then, ["scan_id", "hash"], "full_outer")
    counts = both.groupBy("scan_id").agg(F.count_if(F.col("had").isNull()).alias("new_count"), F.count_if(F.col("has").isNull()).alias("fixed_count"))
    return steps.select("scan_id", "repo").join(counts, "scan_id", "left").fillna(0, ["new_count", "fixed_count"])
