"""Queries over stored scan records, one a scan, in several shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import entries as op
from .bindings import Corpus, registry

QUERIES, ORACLES, query = registry()


def records(c: Corpus) -> DataFrame:
    """The record of each scan as JSON; its fields come and go with the scan's number."""
    k = F.col("scan_id")
    scans = c.scans().select("scan_id", "repo")
    f = c.findings()
    one = F.struct(
        F.col("repo"), F.when(F.col("line") % 3 == 0, "New").otherwise("old").alias("delta_status"), F.when(F.col("supp") % 5 != 0, F.col("rule")).otherwise(F.lit("")).alias("provider_or_lib"),
        "category", F.col("hash").alias("_hash"), F.when(F.col("supp") % 7 == 0, "false_positive").alias("triage_status"),
    )
    found = f.groupBy("scan_id").agg(F.collect_list(one).alias("findings"))  # a scan's findings are its record
    rows = scans.join(found, "scan_id", "left")
    part = F.struct((k % 6).alias("count"), F.create_map(F.lit("1"), k % 3, F.lit("2"), k % 2).alias("sev"))
    kept = F.struct(F.struct(F.create_map(F.lit("rule_a"), k % 11).alias("active"), F.create_map(F.lit("rule_a"), k % 3, F.lit("rule_b"), F.lit(1).cast("long")).alias("suppressed")).alias("rules"))
    json = F.to_json(F.struct(
        F.when(k % 5 < 3, F.array("repo")).when(k % 5 == 3, F.array("repo", F.concat(F.lit("other_"), (k % 7).cast("string")))).alias("repo_slugs"),
        F.when(k % 5 == 4, F.concat(F.lit("/srv/"), "repo", F.lit("/"))).alias("local_repo_path"), F.when(k % 4 != 0, F.col("findings")).alias("findings"),
        F.when(k % 4 == 0, kept).alias("trend"), F.when(k % 7 != 0, F.create_map(F.col("repo"), part)).alias("per_repo"), F.when(k % 3 == 0, k % 9).alias("total"),
        F.struct((k % 4).alias("critical"), F.lit(0).alias("high")).alias("sev"), F.struct((k % 2).alias("new_count"), (k % 8).alias("fixed_count")).alias("delta"),
    ))
    return op.read(rows.select("scan_id", json.alias("record")))


@query("""with found as (select scan_id, count(*)::bigint as n, count(*) filter (line % 3 = 0)::bigint as fresh from findings where scan_id % 4 <> 0 group by scan_id),
r as (select s.scan_id as k, s.repo, s.scan_id % 5 <> 3 as one, s.scan_id % 7 <> 0 as part, coalesce(n, 0) as n, coalesce(fresh, 0) as fresh from scans s left join found f using (scan_id)),
c as (select *, case when part then k % 6 else n end as cnt, case when part then k % 3 else 0 end as s1, case when part then k % 2 else 0 end as s2 from r),
e as (select k as scan_id, repo, case when one then coalesce(nullif(case when k % 3 = 0 then k % 9 else cnt end, 0), cnt) else cnt end as total, case when one then coalesce(nullif(k % 4, 0), s1) else s1 end as critical, s2 as high,
  case when one then coalesce(nullif(k % 2, 0), fresh) else fresh end as new_count, case when one then k % 8 else 0 end as fixed_count from c
  union all select k, 'other_' || (k % 7), 0, 0, 0, 0, 0 from c where not one)
select scan_id, repo, total::bigint as total, critical::bigint as critical, high::bigint as high, 0::bigint as medium, 0::bigint as low, critical::bigint as critical_prod, high::bigint as high_prod, new_count::bigint as new_count, fixed_count::bigint as fixed_count from e""", "findings")
def record_entries(c):
    return op.repo_entries(records(c), ["scan_id"])


@query("""with live as (select hash, case status when 'reviewed' then 'in_remediation' else status end as status from triage),
each as (select case when supp % 5 <> 0 then rule else category end as rule, coalesce(l.status, case when supp % 7 = 0 then 'false_positive' end) = 'false_positive' as gone from findings f left join live l using (hash) where scan_id % 4 <> 0),
kept as (select scan_id as k from scans where scan_id % 4 = 0),
every as (select rule, count(*) filter (gone is not true)::bigint as active, count(*) filter (gone)::bigint as suppressed from each group by rule
  union all select 'rule_a', sum(k % 11)::bigint, sum(k % 3)::bigint from kept union all select 'rule_b', 0, count(*)::bigint from kept)
select rule, sum(active)::bigint as active, sum(suppressed)::bigint as suppressed, sum(active + suppressed)::bigint as noisy from every group by rule""", "findings", "triage")
def record_rule_counters(c):
    return op.rule_counters(records(c), c.triage(), ["scan_id"])
