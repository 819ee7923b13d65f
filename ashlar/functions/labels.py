"""Normalised statuses, severities and their labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Statuses and severities as users read them.
STATUS_LABELS = {
    "false_positive": "FP - Dismissed",
    "accepted_risk": "Accepted Risk",
    "sent_for_review": "Sent for Review",
    "in_remediation": "In Remediation",
    "reviewed": "In Remediation",
    "fixed": "Fixed",
    "open": "Open",
}
SEVERITY_LABELS = {1: "Critical", 2: "High", 3: "Medium", 4: "Low"}


def _lookup(key: Column, table: dict, other: str) -> Column:
    got = F.lit(other)
    for k, label in table.items():
        got = F.when(key == k, label).otherwise(got)
    return got


def triage_status(raw: Column) -> Column:
    """A stored triage status in lower case; ``reviewed`` is the old name of in_remediation."""
    value = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    return F.when(value == "reviewed", "in_remediation").otherwise(value)


def status_label(status: Column) -> Column:
    return _lookup(status, STATUS_LABELS, "Open")


def severity_label(severity: Column, raw: Column) -> Column:
    """A known label as given but for its case; ``Sev-`` labels and none by the number; any other stays."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    by_number = _lookup(severity, SEVERITY_LABELS, "Low")
    known = F.lower(text).isin(*[x.lower() for x in SEVERITY_LABELS.values()])
    return F.when(known, F.initcap(text)).when(F.lower(text).startswith("sev-") | (text == ""), by_number).otherwise(text)
