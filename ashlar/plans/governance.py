"""Queries over roles, tags and rules of repositories, and over what reports show."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import facts, inventory, portfolio
from ..operators import governance as op
from ..operators import reports as rp
from .bindings import Corpus, registry

QUERIES, ORACLES, query = registry()


def profiles(c: Corpus) -> DataFrame:
    """Profiles with the columns that roles, tags and rules are made of, by the customers' numbers."""
    k = F.col("ord")
    some = lambda cond, *values: F.when(cond, F.array(*[F.lit(v) for v in values]))
    return c.profiles().drop("role").select(
        "repo", "ord", some(k % 7 == 0, "React", "Node.js").alias("technologies"), (k % 3 == 0).alias("has_api_surface"), some(k % 5 == 1, "t1").alias("produced_topics"), some(k % 11 == 4, "kafka").alias("event_systems"),
        F.when(k % 4 != 3, k % 4 == 0).alias("has_iac"), some(k % 8 < 3, "gh").alias("ci_systems"), some(k % 6 == 0, "SECURITY.md", "CODEOWNERS").alias("missing_governance"), (k % 9 == 0).alias("prompt_handling"),
        (F.col("balance") < 0).alias("risky_repo"), ((F.col("balance") < 0) & (k % 2 == 0)).alias("orphaned_risky"), (k % 13 == 0).alias("dependency_risk"),
    )


_GOVERNED = """p as (
  select repo, ord as k, balance, ord % 3 = 0 as api, ord % 4 = 0 as iac, ord % 8 < 3 as ci, ord % 6 = 0 as missing, ord % 9 = 0 as prompt, balance < 0 as risky, balance < 0 and ord % 2 = 0 as lost, ord % 13 = 0 as heavy from profiles
), degree as (
  select repo, sum(i)::bigint as i, sum(o)::bigint as o from (select src as repo, 0 as i, 1 as o from edges union all select dst, 1, 0 from edges) group by repo
), v as (
  select p.*, coalesce(i, 0) as i, coalesce(o, 0) as o, list_filter([case when api and missing then 'api_without_security_policy' end, case when iac and not ci then 'iac_without_ci' end, case when prompt and missing then 'ai_without_governance' end, case when lost then 'risky_without_owner' end, case when heavy then 'heavy_dependencies' end], lambda x: x is not null) as violations
  from p left join degree using (repo)
)"""


@query(f"""with {_GOVERNED} select repo, case when k % 7 = 0 then 'ui' when api then 'api' when k % 5 = 1 or k % 11 = 4 then 'worker' when iac then 'platform' else 'service' end as role, violations as policy_violations,
  list_sort(list_filter([case when prompt then 'prompt' end, case when iac then 'iac' end, case when api then 'api' end, case when ci then 'ci' end, case when missing then 'missing_governance' end, case when heavy then 'dependency_risk' end, case when risky then 'risky' end, case when lost then 'orphaned_risky' end,
    case when len(violations) > 0 then 'policy_violation' end, case when i >= 2 then 'inbound_dependency_risk' end, case when o >= 2 then 'outbound_dependency_risk' end, case when i + o >= 3 then 'critical_infrastructure' end], lambda x: x is not null)) as usage_tags from v""", "edges", "profiles")
def usage_tags_and_violations(c):
    return op.governed(profiles(c), portfolio.degrees(c.edges())).select("repo", "role", "policy_violations", "usage_tags")


@query(f"""with {_GOVERNED} select violation, count(*)::bigint as n from (select unnest(violations) as violation from v) group by violation""", "edges", "profiles")
def violation_rollup(c):
    return op.governed(profiles(c)).select(F.explode("policy_violations").alias("violation")).groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


@query("""select repo, case when ord % 7 = 0 then 'React, Node.js' else '' end as technologies, case when ord % 3 = 0 then 'yes' else 'no' end as has_api_surface, case when ord % 4 = 3 then 'no' when ord % 4 = 0 then 'yes' else 'no' end as has_iac,
  case when ord % 6 = 0 then 'SECURITY.md, CODEOWNERS' else '' end as missing_governance, '' as contact, ord::varchar as ord from profiles""", "profiles")
def inventory_export(c):
    return rp.inventory_rows(profiles(c), ["repo", "technologies", "has_api_surface", "has_iac", "missing_governance", "contact", "ord"])


@query("""with w as (select p_brand as repo, p_type || '/' || p_name || '.py' as path, lower(p_type) as a, regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') as b from part),
t as (select repo, path, 0 as pos, a as marker from w union all select repo, path, 1, b from w),
n as (select repo, marker, count(*)::bigint as n, min({'path': path, 'pos': pos}) as first from t where length(marker) >= 4 group by all)
select repo, marker, n from n qualify row_number() over (partition by repo order by n desc, first) <= 16""")
def module_markers(c):
    return facts.module_markers(c.table("part").select(F.col("p_brand").alias("repo"), F.concat("p_type", F.lit("/"), "p_name", F.lit(".py")).alias("path")))


@query("""select repo, count(*)::bigint as findings, list_sort(list(distinct rule)) as providers, list_sort(list(distinct category)) as categories, list_sort(list(distinct 'gpt-' || (part % 9))) as models,
  false as prompts, bool_or(part % 5 = 0) as serving, bool_or(supp % 4 = 1) as agents, bool_or(category = 'RAG/Vector DB') as vectors from findings group by repo""", "findings")
def usage_by_repo(c):
    """Providers, categories, models and kinds of use of each repository."""
    rows = c.findings().select("repo", "rule", "category", F.concat(F.lit("model=gpt-"), (F.col("part") % 9).cast("string")).alias("match"), F.lit("").alias("snippet"), F.when(F.col("part") % 5 == 0, "Inference").when(F.col("supp") % 4 == 1, "x").otherwise("y").alias("capability"), "supp")
    marked = rows.withColumn("capability", F.when(F.col("supp") % 4 == 1, F.concat("capability", F.lit(" agent"))).otherwise(F.col("capability")))
    return inventory.usage(marked.drop("supp"))


def _told(c: Corpus) -> DataFrame:
    text = F.when(F.col("mk") % 3 == 0, F.lit(" ")).when(F.col("mk") % 3 == 1, F.concat(F.lit("fix "), F.col("mk").cast("string")))
    return c.findings().withColumnRenamed("file", "path").withColumn("remediation", text)


@query("""with f as (select *, case mk % 3 when 0 then ' ' when 1 then 'fix ' || mk end as remediation from findings where severity <= 2),
g as (select rule, min(severity) as severity, count(*)::bigint as n, min(struct_pack(a := severity, b := repo, c := file, d := line)) filter (trim(coalesce(remediation, '')) <> '') as at from f group by rule),
t as (select g.rule, any_value(g.severity) as severity, any_value(g.n) as n, min(remediation) as lowest, count(distinct remediation)::bigint as kinds from g join f on f.rule = g.rule and struct_pack(a := f.severity, b := f.repo, c := f.file, d := f.line) = g.at and trim(coalesce(remediation, '')) <> '' group by g.rule),
p as (select distinct rule, repo, file, line from f), k as (select *, row_number() over (partition by rule order by repo, file, line) as k from p)
select t.rule, t.severity, t.n, (select count(*) from p where p.rule = t.rule)::bigint as places, (select list(repo || '/' || file || ':' || line order by repo, file, line) from k where k.rule = t.rule and k.k <= 8) as shown from t""", "findings")
def remediation_groups(c):
    """Serious findings by rule with their first places; the first text is told by tests, as many rows tie here."""
    return rp.remediation_groups(_told(c)).drop("text")


@query("""with o as (select repo, min(owner) as owner from (select 'repo_' || (ord % 50) as repo, owner from profiles) group by repo)
select f.repo, case when mk % 5 = 0 then 'named' else coalesce(o.owner, '') end as owner, count(*)::bigint as n from findings f left join o using (repo) group by all""", "findings", "profiles")
def findings_by_owner(c):
    rows = c.findings().withColumn("owner", F.when(F.col("mk") % 5 == 0, F.lit(" named ")).otherwise(F.lit("")))
    owners = c.profiles().select(F.concat(F.lit("repo_"), (F.col("ord") % 50).cast("string")).alias("repo"), "owner")
    return rp.with_owner(rows, owners).groupBy("repo", "owner").agg(F.count(F.lit(1)).alias("n"))


@query("select repo, rule, n from (select repo, rule, count(*)::bigint as n, row_number() over (partition by repo order by count(*) desc, rule) as k from findings where severity <= 2 group by repo, rule) where k <= 3", "findings")
def top_providers(c):
    """The three commonest rules of severe findings in each repository."""
    return rp.commonest(rp.at_least(c.findings(), 2), "rule", 3, ("repo",))


@query("""select scan_id, repo, file as path, line, severity, context from findings where severity = 2 and contains(lower(concat_ws(' ', repo, file, rule, category, context)), 'rule_1') and context = 'test'
order by severity, case context when 'production' then 1 when 'test' then 2 when 'docs' then 3 else 4 end, repo, file, line, scan_id, part, supp, price limit 100""", "findings")
def report_page(c):
    """The first hundred findings of a filtered report in its order."""
    rows = rp.report_filter(c.findings().withColumnRenamed("file", "path"), "Rule_1", 2, context="test", category=None)
    return rows.orderBy(*rp.report_order(), "scan_id", "part", "supp", "price").limit(100).select("scan_id", "repo", "path", "line", "severity", "context")


@query("select count(*)::bigint as n, count(distinct hash)::bigint as hashes, min(line) as line from findings where hash in (select hash from triage where status = 'accepted_risk')", "findings", "triage")
def selected_findings(c):
    chosen = c.triage().filter("status = 'accepted_risk'")
    return rp.selected(c.findings(), chosen, "hash").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("hash").alias("hashes"), F.min("line").alias("line"))
