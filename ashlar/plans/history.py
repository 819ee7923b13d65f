"""Queries over the history of scans, and the portfolio of repositories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as op
from ..operators import portfolio as pf
from .bindings import Corpus, oracle

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None, *views: str):
    def keep(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Corpus(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = oracle(sql, *views) if views else sql
        return f

    return keep


_RANK = "struct_pack(a := started_at, b := scan_id, c := line, d := part, e := supp, f := price)"
_ORDER = ["started_at", "scan_id", "line", "part", "supp", "price"]
_ROLL = f"""roll as (select hash, min(started_at) as first_seen, max(started_at) as last_seen, count(distinct scan_id)::bigint as scan_count, arg_min(repo, {_RANK}) as repo, arg_min(rule, {_RANK}) as rule,
  arg_max(file, {_RANK}) as file, arg_max(severity, {_RANK}) as severity from findings group by hash)"""


@query(f"with {_ROLL} select r.*, coalesce(t.status, 'open') as status from roll r left join triage t using (hash)", "findings", "triage")
def finding_rollup(c):
    return op.rollup(c.findings(), c.triage(), _ORDER)


_MEASURES = """measures as (select scan_id, repo, count(*)::bigint as total, count(*) filter (severity = 1)::bigint as critical, count(*) filter (severity = 2)::bigint as high, count(*) filter (severity = 3)::bigint as medium,
  count(*) filter (severity = 4)::bigint as low, count(*) filter (severity = 1 and context = 'production')::bigint as critical_prod, count(*) filter (severity = 2 and context = 'production')::bigint as high_prod from findings group by scan_id, repo),
risks as (select *, critical * 10 + high * 5 + medium * 2 + low + critical_prod * 4 + high_prod * 2 as risk from measures)"""


@query(f"with {_MEASURES} select * from risks", "findings")
def trend_findings_over_time(c):
    return op.scan_measures(c.findings())


_RISK = f"""{_MEASURES}, latest as (select r.repo, count(*)::bigint as scan_count, arg_max(risk, struct_pack(a := s.started_at, b := s.scan_id)) as risk, arg_max(critical_prod, struct_pack(a := s.started_at, b := s.scan_id)) as critical_prod
  from risks r join scans s on r.scan_id = s.scan_id group by r.repo)"""


@query(f"with {_RISK} select * from latest", "findings")
def repo_risk(c):
    return op.repo_risk(op.scan_measures(c.findings()), c.scans())


@query(f"with {_RISK} select * from latest order by risk desc, critical_prod desc, repo limit 8", "findings")
def top_repos_by_risk(c):
    return op.repo_risk(op.scan_measures(c.findings()), c.scans()).orderBy(F.desc("risk"), F.desc("critical_prod"), "repo").limit(8)


_RULES = """rules as (select f.rule, count(*) filter (coalesce(t.status, '') <> 'false_positive')::bigint as active, count(*) filter (t.status = 'false_positive')::bigint as suppressed from findings f left join triage t using (hash) group by f.rule)"""


@query(f"with {_RULES} select rule, active, suppressed, round_even(suppressed * 100.0::double / (active + suppressed), 0)::int as rate from rules", "findings", "triage")
def suppression_rate(c):
    return op.rule_counters(c.findings(), c.triage())


@query(f"with {_RULES} select rule, active + suppressed as noisy from rules order by noisy desc, rule limit 8", "findings", "triage")
def top_noisy_rules(c):
    got = op.rule_counters(c.findings(), c.triage()).select("rule", (F.col("active") + F.col("suppressed")).alias("noisy"))
    return got.orderBy(F.desc("noisy"), "rule").limit(8)


@query("select llm_model, count(*)::bigint as scans, count(*) filter (state = 'error')::bigint as failed, round_even(count(*) filter (state = 'error') * 100.0::double / count(*), 0)::int as failure_pct from scans group by llm_model", "scans")
def model_failure_rate(c):
    return op.model_failures(c.scans())


@query("""with steps as (select repo, scan_id, lag(scan_id) over (partition by repo order by started_at, scan_id) as previous_id from scans),
seen as (select distinct scan_id, hash from findings),
now as (select s.scan_id, count(*) filter (p.hash is null)::bigint as new_count from steps s join seen n on n.scan_id = s.scan_id left join seen p on p.scan_id = s.previous_id and p.hash = n.hash group by s.scan_id),
gone as (select s.scan_id, count(*) filter (n.hash is null)::bigint as fixed_count from steps s join seen p on p.scan_id = s.previous_id left join seen n on n.scan_id = s.scan_id and n.hash = p.hash group by s.scan_id)
select s.scan_id, s.repo, coalesce(new_count, 0)::bigint as new_count, coalesce(fixed_count, 0)::bigint as fixed_count from steps s left join now on now.scan_id = s.scan_id left join gone on gone.scan_id = s.scan_id""", "findings")
def trend_new_fixed(c):
    return op.new_and_fixed(c.findings(), c.scans())


@query("select count(*)::bigint as scans, count(distinct repo)::bigint as repos, count(distinct llm_model)::bigint as models, count(*) filter (state = 'done')::bigint as done, min(started_at) as first_at, max(started_at) as last_at from scans", "scans")
def trend_summary(c):
    return c.scans().agg(F.count(F.lit(1)).alias("scans"), F.count_distinct("repo").alias("repos"), F.count_distinct("llm_model").alias("models"), F.count_if(F.col("state") == "done").alias("done"), F.min("started_at").alias("first_at"), F.max("started_at").alias("last_at"))


@query("""with n as (select repo, scan_id, started_at, row_number() over (partition by repo order by started_at desc, scan_id desc) as k from scans)
select a.repo, a.scan_id as latest_id, a.started_at as latest_at, b.scan_id as previous_id, b.started_at as previous_at from n a left join n b on a.repo = b.repo and b.k = 2 where a.k = 1""", "scans")
def latest_previous_snapshot(c):
    return op.latest_two(c.scans())


@query("select project_key, repo, arg_max(scan_id, struct_pack(a := started_at, b := scan_id)) as scan_id, max(started_at) as started_at from scans where state = 'done' group by project_key, repo", "scans")
def latest_record_per_repo(c):
    return op.last_scan_of_repo(c.scans().filter("state = 'done'"))


@query("""with n as (select repo, scan_id, row_number() over (partition by repo order by started_at desc, scan_id desc) as k from scans),
a as (select n.repo, list(distinct rule) as s from n join findings f on f.scan_id = n.scan_id where k = 1 group by n.repo), b as (select n.repo, list(distinct rule) as s from n join findings f on f.scan_id = n.scan_id where k = 2 group by n.repo),
d as (select a.repo, list_sort(list_filter(a.s, lambda x: not list_contains(b.s, x))) as added, list_sort(list_filter(b.s, lambda x: not list_contains(a.s, x))) as removed from a join b on a.repo = b.repo)
select * from d where len(added) > 0 or len(removed) > 0""", "findings")
def architecture_drift(c):
    two = op.latest_two(c.scans())
    found = c.findings().select("scan_id", "rule")
    latest = two.select("repo", F.col("latest_id").alias("scan_id")).join(found, "scan_id")
    previous = two.select("repo", F.col("previous_id").alias("scan_id")).join(found, "scan_id")
    return pf.snapshot_drift(latest, previous, "repo", "rule")


@query("""select kind, value, count(*)::bigint as n from (select unnest([struct_pack(kind := 'owner', value := owner), struct_pack(kind := 'role', value := role), struct_pack(kind := 'segment', value := segment), struct_pack(kind := 'project', value := project_key)], recursive := true) from profiles) group by all""", "profiles")
def attribute_rollup(c):
    return pf.attribute_rollup(c.profiles(), {"owner": "owner", "role": "role", "segment": "segment", "project": "project_key"})


@query("select owner, count(*)::bigint as repos, count(*) filter (balance < 0)::bigint as risky, count(*) filter (role = 'service')::bigint as services from profiles group by owner", "profiles")
def owner_rollups(c):
    return pf.owner_rollup(c.profiles())


@query("""with k as (select list_sort(list_distinct([concat('o:', owner), concat('s:', segment), concat('r:', role)])) as tags, min(repo) as repo, count(*)::bigint as n from profiles group by all),
t as (select repo, n, unnest(tags) as tag from k)
select a.repo as a, b.repo as b, count(*)::bigint as shared, case when a.repo = b.repo then a.n * (a.n - 1) / 2 else a.n * b.n end::bigint as pairs
from t a join t b on a.tag = b.tag and a.repo <= b.repo group by a.repo, b.repo, a.n, b.n having count(*) >= 2 and (a.repo < b.repo or a.n > 1)""", "profiles")
def overlap_pairs(c):
    """Pairs of classes of repos with equal tags; overlap_classes has their members."""
    return pf.overlaps(_tagged(c), "repo", "tags", 2)


@query("""select repo, min(repo) over (partition by tags) as class from (select repo, list_sort(list_distinct([concat('o:', owner), concat('s:', segment), concat('r:', role)])) as tags from profiles)""", "profiles")
def overlap_classes(c):
    return pf.tag_classes(_tagged(c), "repo", "tags").select("repo", F.col("rep").alias("class"))


def _tagged(c):
    tags = F.array(F.concat(F.lit("o:"), "owner"), F.concat(F.lit("s:"), "segment"), F.concat(F.lit("r:"), "role"))
    return c.profiles().select("repo", tags.alias("tags"))


@query("select src, dst from edges", "edges")
def repo_edges(c):
    return c.edges()


@query("select src, dst from edges e where src < dst and exists (select 1 from edges b where b.src = e.dst and b.dst = e.src)", "edges")
def repo_two_cycles(c):
    return pf.two_cycles(c.edges())


@query("""with d as (select src as repo, 1 as o, 0 as i from edges union all select dst, 0, 1 from edges)
select repo, sum(i)::bigint as in_degree, sum(o)::bigint as out_degree, (sum(i) + sum(o))::bigint as centrality from d group by repo""", "edges")
def degree_centrality(c):
    return pf.degrees(c.edges())


@query("select a.owner as src_owner, b.owner as dst_owner, count(*)::bigint as n from edges e join profiles a on a.repo = e.src join profiles b on b.repo = e.dst where a.owner <> b.owner group by all", "edges", "profiles")
def cross_team_flows(c):
    return pf.flows(c.edges(), c.profiles())


@query("""select src, dst, a.role as src_role, b.role as dst_role from edges e join profiles a on a.repo = e.src join profiles b on b.repo = e.dst
where not ((a.role = 'ui' and b.role in ('api', 'service')) or (a.role in ('api', 'worker', 'service') and b.role in ('service', 'platform', 'library')) or (a.role = 'platform' and b.role in ('platform', 'library')))""", "edges", "profiles")
def boundary_violations(c):
    return pf.boundary_violations(c.edges(), c.profiles())


@query("""select concat_ws(' -> ', src, dst, src) as cycle from edges e where src < dst and exists (select 1 from edges b where b.src = e.dst and b.dst = e.src)
union all select concat_ws(' -> ', x.src, x.dst, y.dst, x.src) from edges x join edges y on x.dst = y.src join edges z on y.dst = z.src and z.dst = x.src where x.src < x.dst and x.src < y.dst""", "edges")
def short_cycles(c):
    return pf.short_cycles(c.edges())


@query()
def import_cycles(c):
    """Depth-first back-edge cycles of each repository's import graph."""
    rows = c.table("lineitem").select(F.expr("l_orderkey div 60").alias("g"), F.expr("l_partkey div 8").alias("a"), F.expr("l_suppkey * 5 div 2").alias("b")).filter("a <> b")
    module = lambda x: F.concat(F.lit("m"), F.col(x).cast("string"), F.lit(".py"))
    return pf.import_cycles(rows.select(F.concat(F.lit("repo_"), F.col("g").cast("string")).alias("group"), module("a").alias("src"), module("b").alias("dst")).distinct())


@query("select project_key, count(*)::bigint as repos, count(*) filter (role in ('api', 'ui'))::bigint as exposed, count(*) filter (balance < 0)::bigint as risky, count(distinct owner)::bigint as owners from profiles group by project_key", "profiles")
def portfolio_summary(c):
    return c.profiles().groupBy("project_key").agg(F.count(F.lit(1)).alias("repos"), F.count_if(F.col("role").isin("api", "ui")).alias("exposed"), F.count_if(F.col("balance") < 0).alias("risky"), F.count_distinct("owner").alias("owners"))


@query("select repo, owner, segment from profiles where contains(lower(owner), 'nation_1') and segment = 'BUILDING'", "profiles")
def inventory_filter(c):
    return c.profiles().filter(F.contains(F.lower("owner"), F.lit("nation_1")) & (F.col("segment") == "BUILDING")).select("repo", "owner", "segment")


@query("select f.hash, f.repo from findings f where (f.project_key, f.repo) in (select project_key, repo from profiles where role = 'api') group by all", "findings", "profiles")
def scope_semi_join(c):
    return c.findings().join(c.profiles().filter("role = 'api'"), ["project_key", "repo"], "left_semi").select("hash", "repo").distinct()
