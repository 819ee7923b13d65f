"""Queries over the lives of findings: every sighting in every scan, real fixes, triage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import lifecycle as op
from ..operators.findings import page, rows_by_rank
from .bindings import Corpus, registry

QUERIES, ORACLES, query = registry()

ORDER = ["scan_id", "line", "part", "supp", "price"]


def scans(c: Corpus) -> DataFrame:
    """Scans with times as text; of one customer in 17 the text is no date, and few name their end."""
    at = F.date_format("started_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return c.scans().select(
        "scan_id", "repo",
        F.when(F.col("scan_id") % 17 == 0, F.concat(F.lit("unknown-"), F.col("scan_id").cast("string"))).otherwise(at).alias("started"),
        F.when(F.col("scan_id") % 3 == 0, F.date_format(F.col("started_at") + F.expr("interval 1 day"), "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.lit("")).alias("completed"),
    )


def sightings(c: Corpus) -> DataFrame:
    """Findings of every scan; attributes that a scan left empty are so by their own numbers."""
    part, line = F.col("part"), F.col("line")
    unless = lambda gap, value: F.when(gap, F.lit("")).otherwise(value)
    return c.findings().drop("started_at").join(scans(c).select("scan_id", "started"), "scan_id").select(
        "scan_id", "repo", "project_key", "hash", "started", "file", "line", "rule", "category", "context", "part", "supp", "price",
        F.when(F.col("confidence") % 5 == 0, F.lit(0)).otherwise(F.col("severity")).alias("severity"),
        unless(line % 2 == 0, F.concat(F.lit("cap "), (part % 9).cast("string"))).alias("capability"),
        unless(line % 3 == 0, F.concat(F.lit("seen at "), line.cast("string"))).alias("description"),
        F.when(line % 4 != 0, F.concat(F.lit("s"), F.col("confidence").cast("string"))).alias("snippet"),
        unless(F.col("supp") % 4 > 0, F.lit("approved")).alias("policy_status"),
        F.when(line == 1, F.lit("HIGH")).when(line == 2, F.lit("Sev-2 (x)")).when(line == 3, F.lit("own label")).otherwise(F.lit("")).alias("severity_label"),
        F.when(F.col("supp") % 7 == 0, F.lit("false_positive")).when(F.col("supp") % 7 == 1, F.lit("reviewed")).alias("triage_status"),
    )


def triage(c: Corpus) -> DataFrame:
    h = F.col("hash")
    return c.triage().select("hash", "status", F.concat(F.lit("note "), F.substring(h, 1, 4)).alias("note"), F.concat(F.lit("user "), F.substring(h, 1, 1)).alias("marked_by"), F.lit(None).cast("string").alias("marked_at"))


_SIGHTINGS = """stamped as (
  select scan_id, repo, case when scan_id % 17 = 0 then 'unknown-' || scan_id else strftime(started_at, '%Y-%m-%dT%H:%M:%SZ') end as started,
    case when scan_id % 17 = 0 then 0 else epoch(started_at)::bigint end as started_epoch,
    case when scan_id % 3 = 0 then strftime(started_at + interval 1 day, '%Y-%m-%dT%H:%M:%SZ') when scan_id % 17 = 0 then 'unknown-' || scan_id else strftime(started_at, '%Y-%m-%dT%H:%M:%SZ') end as ended,
    case when scan_id % 3 = 0 then epoch(started_at + interval 1 day)::bigint when scan_id % 17 = 0 then 0 else epoch(started_at)::bigint end as ended_epoch from scans
), sightings as (
  select f.scan_id, f.repo, f.project_key, f.hash, s.started, s.started_epoch, f.file, f.line, f.rule, f.category, f.context, f.part, f.supp, f.price, case when f.confidence % 5 = 0 then 0 else f.severity end as severity,
    case when f.line % 2 = 0 then '' else 'cap ' || (f.part % 9) end as capability, case when f.line % 3 = 0 then '' else 'seen at ' || f.line end as description,
    case when f.line % 4 <> 0 then 's' || f.confidence end as snippet, case when f.supp % 4 > 0 then '' else 'approved' end as policy_status,
    case f.line when 1 then 'HIGH' when 2 then 'Sev-2 (x)' when 3 then 'own label' else '' end as severity_label,
    case f.supp % 7 when 0 then 'false_positive' when 1 then 'in_remediation' end as triage_status
  from findings f join stamped s on f.scan_id = s.scan_id
), known as (
  select hash, case status when 'reviewed' then 'in_remediation' else status end as t, 'note ' || left(hash, 4) as note, 'user ' || left(hash, 1) as marked_by from triage
), steps as (
  select scan_id, {'epoch': ended_epoch, 'raw': ended} as fixed, lag(scan_id) over (partition by repo order by started_epoch, started, scan_id) as before from stamped
), seen as (
  select distinct scan_id, hash from sightings
), marks as (
  select h.hash, max(s.fixed) as fixed from steps s join seen h on h.scan_id = s.before left join seen n on n.scan_id = s.scan_id and n.hash = h.hash where n.hash is null group by h.hash
)"""
_TIE = "e := scan_id, f := line, g := part, h := supp, i := price"
_RANK = f"struct_pack(a := started_epoch, b := started, {_TIE})"
_LIFE = f"""{_SIGHTINGS}, grouped as (
  select hash, arg_min(struct_pack(at := started, id := scan_id), {_RANK}) as f, arg_max(struct_pack(at := started, id := scan_id), {_RANK}) as l, max(started_epoch) as last_epoch, count(*)::bigint as scan_count,
    count(*) filter (triage_status = 'false_positive')::bigint as suppression_hits,
    {", ".join(f"arg_min({c}, struct_pack({_TIE})) as {c}" for c in ("project_key", "repo", "rule", "context"))},
    {", ".join(f"arg_max({c}, {_RANK}) filter ({c} is not null and {c}::varchar not in ('', '0')) as {c}" for c in ("file", "line", "severity", "capability", "description", "snippet", "policy_status"))},
    arg_max(severity_label, {_RANK}) as label
  from sightings group by hash
), lives as (
  select g.*, coalesce(severity, 4) as sev, k.t, k.note, k.marked_by, case when k.t in ('accepted_risk', 'false_positive') then k.t when m.fixed.epoch > 0 and m.fixed.epoch >= g.last_epoch then 'fixed' else coalesce(k.t, 'open') end as status
  from grouped g left join marks m using (hash) left join known k using (hash)
), told as (
  select hash, project_key, repo, rule, context, file, line, sev as severity, capability, description, snippet, policy_status, scan_count, suppression_hits, status,
    case when label = 'HIGH' then 'High' when label = 'own label' then label else case sev when 1 then 'Critical' when 2 then 'High' when 3 then 'Medium' else 'Low' end end as severity_label,
    f.at as first_seen_at, f.id as first_seen_scan_id, l.at as last_seen_at, l.id as last_seen_scan_id,
    case status when 'false_positive' then 'FP - Dismissed' when 'accepted_risk' then 'Accepted Risk' when 'sent_for_review' then 'Sent for Review' when 'in_remediation' then 'In Remediation' when 'fixed' then 'Fixed' else 'Open' end as status_label,
    case when status = t then note else '' end as triage_note, case when status = t then marked_by else '' end as triage_by, '' as triage_at from lives
)"""


def _lives(c: Corpus) -> DataFrame:
    return op.lifecycle(sightings(c), op.fixes(scans(c), c.findings()), triage(c), ORDER)


@query(f"with {_LIFE} select * from told", "findings", "triage")
def finding_lifecycle(c):
    return _lives(c)


@query(f"with {_SIGHTINGS} select hash, fixed.epoch as epoch, fixed.raw as raw from marks", "findings", "triage")
def finding_fixes(c):
    return op.fixes(scans(c), c.findings()).select("hash", "fixed.*")


@query(f"""with {_LIFE} select count(*)::bigint as total, count(*) filter (status = 'open')::bigint as open, count(*) filter (status = 'sent_for_review')::bigint as sent_for_review,
  count(*) filter (status in ('in_remediation', 'reviewed'))::bigint as in_remediation, count(*) filter (status = 'accepted_risk')::bigint as accepted_risk,
  count(*) filter (status = 'false_positive')::bigint as suppressed, count(*) filter (status = 'fixed')::bigint as fixed from told""", "findings", "triage")  # fmt: skip
def finding_status_summary(c):
    return op.status_counts(_lives(c))


@query(f"with {_LIFE} select status, count(*)::bigint as n from told group by status", "findings", "triage")
def findings_status_counts(c):
    return _lives(c).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_LIFE} select hash, status, severity, scan_count, repo, file from told order by status = 'fixed', severity, -scan_count, repo, file, hash limit 50 offset 50", "findings", "triage")
def finding_lifecycle_page(c):
    """The second page of fifty, in the order of the findings page."""
    return page(_lives(c), op.page_order(), 2, 50).select("hash", "status", "severity", "scan_count", "repo", "file")


@query(f"""with {_SIGHTINGS}, ranked as (select s.scan_id, s.hash, coalesce(k.t, 'open') as status, s.severity, s.repo, s.file, s.line, s.part, s.supp, s.price, s.description,
    row_number() over (partition by s.scan_id order by s.severity, s.repo, s.file, s.line::varchar, s.part, s.supp, s.price) as n from sightings s left join known k using (hash))
  select scan_id, hash, status, severity, repo, file, line, (status = 'false_positive')::bigint as suppression_hits from ranked where n <= 3""", "findings", "triage")
def scan_findings_first(c):
    """The first three findings of every scan in the order of a scan's page."""
    rows = op.scan_findings(sightings(c), triage(c))
    return rows_by_rank(rows, ["scan_id"], [*op.scan_order(), "part", "supp", "price"], 3).select("scan_id", "hash", "status", "severity", "repo", "file", "line", "suppression_hits")
