"""Queries over scans, sessions, inventories and reports."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions import text as tx
from ..operators import findings as op
from ..operators import inventory as inv
from .bindings import Corpus, oracle

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None, *views: str):
    def keep(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Corpus(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = oracle(sql, *views) if views else sql
        return f

    return keep


@query("""select scan_id, to_json(map_from_entries(list_sort(list((c, n)))))::varchar as ctx from (select scan_id, context as c, count(*)::bigint as n from findings group by all) group by scan_id""", "findings")
def scan_context_histogram(c):
    n = c.findings().groupBy("scan_id", "context").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("scan_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("context", "n"))))).alias("ctx"))


@query("""with d as (select count(*)::bigint as scans, count(*) filter (n > 4)::bigint as detailed from (select scan_id, count(*) as n from findings group by scan_id))
select scans, detailed, scans - detailed as summary_only, case when detailed = 0 then 'none' when detailed < scans then 'partial' else 'complete' end as notice from d""", "findings")
def history_notice(c):
    got = c.findings().groupBy("scan_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("scans"), F.count_if(F.col("n") > 4).alias("detailed"))
    return got.withColumn("summary_only", F.col("scans") - F.col("detailed")).withColumn("notice", F.when(F.col("detailed") == 0, "none").when(F.col("detailed") < F.col("scans"), "partial").otherwise("complete"))


@query("select repo, status, count(*)::bigint as n from (select f.repo, coalesce(t.status, 'open') as status from findings f left join triage t using (hash)) group by all", "findings", "triage")
def session_triage_histogram(c):
    got = op.annotate_triage(c.findings(), c.triage())
    return got.groupBy("repo", F.coalesce("status", F.lit("open")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("""select project_key, list_sort(list(distinct hash)) [1:8] as new_hashes, count(distinct hash)::bigint as n from findings group by project_key""", "findings")
def project_delta_union(c):
    return op.first_values(c.findings(), ["project_key"], "hash", 8).withColumnRenamed("first", "new_hashes")


@query("""select count(distinct (repo, file))::bigint as files, count(*) filter (severity = 1)::bigint as critical, count(*) filter (severity = 2)::bigint as restricted, count(distinct rule)::bigint as languages, min(severity) as worst,
round_even((count(*) - count(*) filter (mk % 7 = 0)) * 100.0::double / count(*), 0)::int as kept_pct from findings""", "findings")
def report_header(c):
    return c.findings().agg(
        F.count_distinct("repo", "file").alias("files"), F.count_if(F.col("severity") == 1).alias("critical"), F.count_if(F.col("severity") == 2).alias("restricted"), F.count_distinct("rule").alias("languages"), F.min("severity").alias("worst"),
        F.bround((F.count(F.lit(1)) - F.count_if(F.col("mk") % 7 == 0)) * 100.0 / F.count(F.lit(1)), 0).cast("int").alias("kept_pct"),
    )


@query("""select rule, repo, project_key, scan_id, started_at from (select *, row_number() over (partition by rule, repo order by started_at desc, scan_id desc, line, part, supp, price) as k from findings) where k <= 12""", "findings")
def repo_recent_scans(c):
    order = [F.desc("started_at"), F.desc("scan_id"), "line", "part", "supp", "price"]
    return op.rows_by_rank(c.findings(), ["rule", "repo"], order, 12).select("rule", "repo", "project_key", "scan_id", "started_at")


@query("""with s as (select scan_id, repo, state from scans), live as (select scan_id, repo, 'running' as state from scans where scan_id % 500 = 0)
select scan_id, repo, case when state = 'running' then 'stopped' else state end as state from live union all select * from s where scan_id not in (select scan_id from live)""", "scans")
def live_session_overrides(c):
    live = c.scans().filter("scan_id % 500 = 0").select("scan_id", "repo", F.lit("running").alias("state"))
    return inv.overridden(c.scans().select("scan_id", "repo", "state"), live)


@query("""with h as (select scan_id, repo, started_at, min(started_at) over (partition by repo) as first_at from scans) select scan_id, repo, date_diff('day', first_at, started_at)::int as age_days,
case when date_diff('day', first_at, started_at) < 365 then 'young' else 'old' end as age from h""", "scans")
def scan_age(c):
    first = c.scans().groupBy("repo").agg(F.min("started_at").alias("first_at"))
    days = F.datediff("started_at", "first_at")
    return c.scans().join(first, "repo").select("scan_id", "repo", days.alias("age_days"), F.when(days < 365, "young").otherwise("old").alias("age"))


@query("""select repo, role, owner, array_to_string(list_filter([case when role = 'ui' then 'UI' end, case when role in ('ui', 'api') then 'API' end, 'Services', case when balance > 5000 then 'Data' end, case when segment = 'BUILDING' then 'External' end], lambda x: x is not null), '>') as flow from profiles""", "profiles")
def architecture_flow(c):
    step = lambda cond, name: F.when(cond, F.lit(name))
    flow = F.array_compact(F.array(step(F.col("role") == "ui", "UI"), step(F.col("role").isin("ui", "api"), "API"), F.lit("Services"), step(F.col("balance") > 5000, "Data"), step(F.col("segment") == "BUILDING", "External")))
    return c.profiles().select("repo", "role", "owner", F.array_join(flow, ">").alias("flow"))


@query("""with produced as (select distinct s_suppkey % 40 as topic, concat('repo_', cast(s_suppkey % 30 as varchar(9))) as producer from supplier), consumed as (select distinct c_custkey % 40 as topic, concat('repo_', cast(c_custkey % 30 as varchar(9))) as consumer from customer)
select p.topic, p.producer, c.consumer, a.owner as producer_owner, b.owner as consumer_owner from produced p join consumed c on p.topic = c.topic join profiles a on a.repo = p.producer join profiles b on b.repo = c.consumer where a.owner <> b.owner""", "profiles")
def topic_coupling(c):
    name = lambda x: F.concat(F.lit("repo_"), x.cast("string"))
    produced = c.table("supplier").select((F.col("s_suppkey") % 40).alias("topic"), name(F.col("s_suppkey") % 30).alias("repo")).distinct()
    consumed = c.table("customer").select((F.col("c_custkey") % 40).alias("topic"), name(F.col("c_custkey") % 30).alias("repo")).distinct()
    return inv.coupling(produced, consumed, "topic", c.profiles().select("repo", "owner"))


@query("""with x as (select src, dst, row_number() over (partition by replace(lower(dst), '_', '-') order by src desc) as k from edges) select src, replace(lower(dst), '_', '-') as alias from x where k = 1""", "edges")
def alias_last_wins(c):
    alias = F.translate(F.lower("dst"), "_.", "--")
    return c.edges().groupBy(alias.alias("alias")).agg(F.max("src").alias("src"))


@query("""select severity, case severity when 1 then 60 when 2 then 40 when 3 then 20 else 5 end as weight, max(n) over () as most, n, round(n * 100.0 / max(n) over (), 6) as bar from (select severity, count(*)::bigint as n from findings group by severity)""", "findings")
def bar_scaling(c):
    n = c.findings().groupBy("severity").agg(F.count(F.lit(1)).alias("n")).withColumn("most", F.max("n").over(W.partitionBy()))  # one row a severity
    weight = F.when(F.col("severity") == 1, 60).when(F.col("severity") == 2, 40).when(F.col("severity") == 3, 20).otherwise(5)
    return n.select("severity", weight.alias("weight"), "most", "n", F.round(F.col("n") * 100.0 / F.col("most"), 6).alias("bar"))


@query("select event_id, lpad(cast(floor(floor(value) / 60) as int)::varchar, 2, '0') || ':' || lpad((floor(value)::int % 60)::varchar, 2, '0') as mmss from (select event_id, greatest(value, 0) as value from events)")
def duration_format(c):
    return c.table("events").select("event_id", tx.mmss(F.col("value")).alias("mmss"))


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, case when l_quantity < 7 then 1 when l_quantity < 15 then 2 when l_quantity < 35 then 3 else 4 end as workers from lineitem""")
def worker_tiers(c):
    return c.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", inv.tier(F.col("l_quantity"), ((7, 1), (15, 2), (35, 3)), 4).alias("workers"))


@query("""with v as (select l_orderkey as scan_id, l_linenumber as line, l_partkey as part, l_suppkey as supp, l_extendedprice as price, case l_partkey % 5 when 0 then 'dismiss' when 1 then 'downgrade' else 'keep' end as verdict from lineitem)
select f.scan_id, f.line, f.part, f.supp, f.price, case when v.verdict = 'downgrade' then least(severity + 1, 4) else severity end as severity from findings f join (select distinct part, verdict from v) v using (part) where v.verdict <> 'dismiss'""", "findings")
def verdicts_applied(c):
    verdicts = c.findings().select("part").distinct().select("part", F.when(F.col("part") % 5 == 0, "dismiss").when(F.col("part") % 5 == 1, "downgrade").otherwise("keep").alias("verdict"))
    got = c.findings().join(verdicts, "part").filter("verdict <> 'dismiss'")
    return got.select("scan_id", "line", "part", "supp", "price", F.when(F.col("verdict") == "downgrade", F.least(F.col("severity") + 1, F.lit(4))).otherwise(F.col("severity")).alias("severity"))


@query("select scan_id, line, part, supp, price from findings where (confidence < 55 or context in ('docs', 'test')) and rule not in ('rule_2', 'rule_5')", "findings")
def review_eligible(c):
    from ..operators.review import eligible

    return c.findings().filter(eligible(("rule_2", "rule_5"))).select("scan_id", "line", "part", "supp", "price")


@query("""select hash, case when rule in ('rule_0', 'rule_1') then 'rotate' when category = 'Security' then 'review' else 'document' end as remediation from (select distinct hash, rule, category from findings)""", "findings")
def remediation_lookup(c):
    """Two left joins, by rule and by category, then the default."""
    by_rule = c.spark.createDataFrame([("rule_0", "rotate"), ("rule_1", "rotate")], "rule string, a string")
    by_category = c.spark.createDataFrame([("Security", "review")], "category string, b string")
    rows = c.findings().select("hash", "rule", "category").distinct().join(F.broadcast(by_rule), "rule", "left").join(F.broadcast(by_category), "category", "left")
    return rows.select("hash", F.coalesce("a", "b", F.lit("document")).alias("remediation"))


@query("select concat('threat_', substr(sha1(concat_ws('|', repo, file, rule)), 1, 12)) as id, repo, file, rule from findings group by all", "findings")
def threat_ids(c):
    return c.findings().select(tx.short_id("threat", F.col("repo"), F.col("file"), F.col("rule")).alias("id"), "repo", "file", "rule").distinct()


@query("""select repo, case when count(*) filter (severity = 1) > 10 then 'Critical' when count(*) filter (severity = 2) > 10 then 'High' else 'Low' end as label, count(*)::bigint as n from findings group by repo""", "findings")
def repo_risk_labels(c):
    got = c.findings().groupBy("repo").agg(F.count_if(F.col("severity") == 1).alias("c"), F.count_if(F.col("severity") == 2).alias("h"), F.count(F.lit(1)).alias("n"))
    return got.select("repo", F.when(F.col("c") > 10, scoring.LABELS[1]).when(F.col("h") > 10, scoring.LABELS[2]).otherwise(scoring.LABELS[4]).alias("label"), "n")


@query("""select conv_id, turn, role, coalesce(lag(role) over (partition by conv_id order by turn, role, text), 'start') as before, length(text)::int as chars from conversations""")
def conversation_turns(c):
    return inv.with_previous(c.table("conversations"), "conv_id", ["turn", "role", "text"], "role", "start").select("conv_id", "turn", "role", "before", F.length("text").alias("chars"))
