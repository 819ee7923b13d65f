"""The life of each finding over all scans: when it was seen, what was last known, how it ended.

A scan's time is the pair (epoch, text as given), so that times which are no date
order among themselves. Rows of one time go by ``order``, columns that tell how the
history is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.labels import severity_label, status_label, triage_status
from .facts import safe_datetime

#: Attributes that stay as the first record read has them, and those that any later sighting renews.
FIRST = ("project_key", "repo", "rule", "context")
RENEWED = ("file", "line", "severity", "capability", "description", "snippet", "policy_status")


def filled(c: Column) -> Column:
    """Neither null, nor empty, nor zero."""
    return c.isNotNull() & ~c.cast("string").isin("", "0", "0.0")


def fixes(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """hash, fixed: when each finding last left the baseline.

    ``scans`` has repo, scan_id, started, completed (texts), ``findings`` scan_id and
    hash. A finding is fixed by a scan that lacks it while the scan of the same repo
    before has it; ``fixed`` is the latest such scan's (epoch, raw), its end or else its
    start. The window is over scans, a few bytes each; findings meet by keys. Equal rows
    change neither what is lacking nor a maximum, so no table of them is held in memory.
    """
    stamp = safe_datetime(F.coalesce(F.nullif(F.col("completed"), F.lit("")), F.col("started")))
    in_order = W.partitionBy("repo").orderBy(safe_datetime(F.col("started")), "scan_id")
    steps = scans.select("scan_id", stamp.alias("fixed"), F.lag("scan_id").over(in_order).alias("before")).filter(F.col("before").isNotNull())
    seen = findings.filter(filled(F.col("hash"))).select("scan_id", "hash")
    had = steps.join(seen.withColumnRenamed("scan_id", "before"), "before")
    gone = had.join(seen, ["scan_id", "hash"], "left_anti")
    return gone.groupBy("hash").agg(F.max("fixed").alias("fixed"))


def lifecycle(findings: DataFrame, marks: DataFrame, triage: DataFrame, order: list[str], first=FIRST, renewed=RENEWED) -> DataFrame:
    """One row a finding hash over all scans.

    ``findings`` has hash, scan_id, started, triage_status (as stored with the scan)
    and the attributes; ``marks`` is ``fixes``; ``triage`` has hash, status, note,
    marked_by and marked_at, one row a hash. Attributes of ``first`` are those of the
    first row in ``order``; of each of ``renewed`` the latest value that is filled counts,
    whichever row has it. ``scan_count`` counts rows and ``suppression_hits`` those
    stored as false positives. Accepted risks and false positives keep their
    status; else a finding is fixed if its mark is not older than its last sighting;
    else triage decides; else it is open. Rows without hash are left out.

    All is one aggregate with partial sums: a hash of very many scans is no large group.
    """
    stamp = safe_datetime(F.col("started"))
    rank = F.struct(stamp.alias("at"), *order)
    seen = F.struct(F.coalesce("started", F.lit("")).alias("at"), "scan_id")
    got = findings.filter(filled(F.col("hash"))).groupBy("hash").agg(
        F.min_by(seen, rank).alias("f"), F.max_by(seen, rank).alias("l"), F.max(stamp["epoch"]).alias("last_epoch"),
        F.count(F.lit(1)).alias("scan_count"), F.count_if(triage_status(F.col("triage_status")) == "false_positive").alias("suppression_hits"),
        *[F.min_by(c, F.struct(*order)).alias(c) for c in first],
        *[F.max_by(c, F.when(filled(F.col(c)), rank)).alias(c) for c in renewed],
        F.max_by("severity_label", rank).alias("severity_label"),
    )
    known = triage.select("hash", triage_status(F.col("status")).alias("t"), "note", "marked_by", "marked_at")
    got = got.join(marks, "hash", "left").join(known, "hash", "left")
    decided = F.col("t").isin("accepted_risk", "false_positive")
    fixed = (F.coalesce(F.col("fixed.epoch"), F.lit(0)) > 0) & (F.col("fixed.epoch") >= F.col("last_epoch"))
    by_triage = F.coalesce(F.nullif("t", F.lit("")), F.lit("open"))
    got = got.withColumn("status", F.when(decided, F.col("t")).when(fixed, F.lit("fixed")).otherwise(by_triage))
    told = lambda c: F.when(F.col("status") == F.col("t"), F.coalesce(c, F.lit(""))).otherwise(F.lit(""))
    return got.select(
        "hash", *first, *[c for c in renewed if c != "severity"], F.coalesce("severity", F.lit(4)).alias("severity"),
        severity_label(F.coalesce("severity", F.lit(4)), F.col("severity_label")).alias("severity_label"),
        F.col("f.at").alias("first_seen_at"), F.col("f.scan_id").alias("first_seen_scan_id"),
        F.col("l.at").alias("last_seen_at"), F.col("l.scan_id").alias("last_seen_scan_id"),
        "scan_count", "suppression_hits", "status", status_label(F.col("status")).alias("status_label"),
        told("note").alias("triage_note"), told("marked_by").alias("triage_by"), told("marked_at").alias("triage_at"),
    )


def status_counts(lives: DataFrame) -> DataFrame:
    """One row: total and the findings of each status; reviewed ones count as in remediation."""
    n = lambda *of: F.count_if(F.col("status").isin(*of))
    return lives.agg(
        F.count(F.lit(1)).alias("total"), n("open").alias("open"), n("sent_for_review").alias("sent_for_review"), n("in_remediation", "reviewed").alias("in_remediation"),
        n("accepted_risk").alias("accepted_risk"), n("false_positive").alias("suppressed"), n("fixed").alias("fixed"),
    )


def page_order() -> list[Column]:
    """Order of the findings page: fixed ones last, then severity, sightings, repo, file; hash settles ties."""
    return [F.col("status") == "fixed", F.col("severity"), -F.col("scan_count"), F.col("repo"), F.col("file"), F.col("hash")]


def scan_findings(findings: DataFrame, triage: DataFrame) -> DataFrame:
    """The findings of scans with the status that triage gives them now, and whether that suppresses them."""
    known = triage.select("hash", triage_status(F.col("status")).alias("t"))
    got = findings.filter(filled(F.col("hash"))).join(known, "hash", "left").withColumn("status", F.coalesce(F.nullif("t", F.lit("")), F.lit("open")))
    return got.drop("t").withColumns({"status_label": status_label(F.col("status")), "suppression_hits": (F.col("status") == "false_positive").cast("long")})


def scan_order() -> list[Column]:
    """Order of one scan's findings: severity, repo, file, then lines as text."""
    return [F.col("severity"), F.col("repo"), F.col("file"), F.col("line").cast("string")]
