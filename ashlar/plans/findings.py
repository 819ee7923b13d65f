"""Queries over findings: scores, policy, dedupe, triage, delta, counts, pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.text import stable_id, title_label
from ..operators import findings as op
from .bindings import Corpus, oracle

SEQ = ["scan_id", "line", "part", "supp", "price"]
_SEQ = ", ".join(SEQ)
CUT = "1998-01-01"
QUERIES, ORACLES = {}, {}


def query(sql: str | None = None, *views: str):
    """Registers a query under its name, with its SQL over the named views."""

    def keep(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Corpus(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = oracle(sql, *views) if views else sql
        return f

    return keep


_STATUS = """case when rule in ('rule_0') then 'CRITICAL' when category = 'Security' and context <> 'production' then 'REVIEW' when category = 'Security' then 'CRITICAL'
    when policy_list = 'banned' then 'BANNED' when policy_list = 'restricted' then 'RESTRICTED' when policy_list = 'approved' then 'APPROVED' else 'REVIEW' end"""
_SEVERITY = """case when rule in ('rule_0') then 1 when category = 'Security' and context <> 'production' then greatest(severity, 3) when category = 'Security' then 1
    when policy_list = 'banned' then least(severity, 1) when policy_list = 'restricted' then least(severity, 2) when policy_list = 'approved' then least(severity + 1, 4) else severity end"""
_JUDGED = f"judged as (select f.* exclude (severity), {_STATUS} as policy_status, {_SEVERITY} as severity from findings f left join lists using (rule))"


def judged(c: Corpus):
    return op.with_policy(c.findings(), c.lists(), always=("rule_0",))


@query(f"""with {_JUDGED}, one as (select * from judged qualify row_number() over (partition by hash order by {_SEQ}) = 1)
select kind, value, count(*)::bigint as n from (select unnest([struct_pack(kind := 'category', value := category), struct_pack(kind := 'severity', value := severity::varchar),
  struct_pack(kind := 'policy', value := policy_status), struct_pack(kind := 'repo', value := repo), struct_pack(kind := 'total', value := 'all')], recursive := true) from one) group by kind, value""", "findings", "lists")
def findings_summary(c):
    """Policy, dedupe and the summary counts: the flagship."""
    return op.summary(op.first_wins(judged(c), "hash", SEQ))


@query(f"select hash, repo, file, line, severity, rule, scan_id from findings qualify row_number() over (partition by hash order by {_SEQ}) = 1", "findings")
def findings_dedupe_first_wins(c):
    return op.first_wins(c.findings(), "hash", SEQ).select("hash", "repo", "file", "line", "severity", "rule", "scan_id")


@query(f"with {_JUDGED} select policy_status, severity, context, count(*)::bigint as n from judged group by all", "findings", "lists")
def policy_status(c):
    return judged(c).groupBy("policy_status", "severity", "context").agg(F.count(F.lit(1)).alias("n"))


@query("""select scan_id, part, supp, line, price, greatest(5, least(98, round_even(100.0::double / (1.0::double + exp(-(ln(0.35::double / 0.65::double)
  + case when category = 'Security' then 0.65::double else 0 end + case when mk % 3 = 0 then 1.2::double else 0 end + case when mk % 5 = 0 then 0.9::double else 0 end
  + case when context = 'test' then -1.4::double else 0 end + case when context = 'docs' then -0.8::double else 0 end))), 0)::int)) as confidence from findings""", "findings")
def confidence_score(c):
    signals = {"security": F.col("category") == "Security", "import_guard": F.col("mk") % 3 == 0, "direct_assignment": F.col("mk") % 5 == 0, "test": F.col("context") == "test", "docs": F.col("context") == "docs"}
    return c.findings().select("scan_id", "part", "supp", "line", "price", scoring.confidence(signals).alias("confidence"))


@query(f"""with {_JUDGED}, parts as (select *, least(100, greatest(0, case context when 'production' then 85 when 'docs' then 15 else 30 end
  + case severity when 1 then 12 when 2 then 8 when 3 then 3 else 0 end + case when policy_status in ('CRITICAL', 'BANNED', 'RESTRICTED') then 6 else 0 end)) as prod,
  least(100, greatest(0, 35 + 18 + 12 + case when length(rule) >= 16 then 5 else 0 end + 4 + case when rule = 'rule_0' then 14 else 0 end - case when context <> 'production' then 10 else 0 end)) as evid from judged)
select scan_id, part, supp, line, price, prod, evid, least(100, greatest(0, round_even(confidence * 0.4::double + prod * 0.35::double + evid * 0.25::double, 0)::int)) as overall from parts""", "findings", "lists")
def overall_signal(c):
    rows = judged(c).withColumns({"snippet": F.lit("code"), "match": F.col("rule"), "capability": F.lit("x"), "corroboration": F.lit(0)})
    rows = rows.withColumn("prod", scoring.production_relevance()).withColumn("evid", scoring.evidence_quality(("rule_0",)))
    return rows.select("scan_id", "part", "supp", "line", "price", "prod", "evid", scoring.overall_signal(F.col("confidence"), F.col("prod"), F.col("evid")).alias("overall"))


@query("select severity, case severity when 1 then 'Sev-1 (Critical)' when 2 then 'Sev-2 (High)' when 3 then 'Sev-3 (Medium)' else 'Sev-4 (Low)' end as label, count(*)::bigint as n from findings group by all", "findings")
def severity_labels(c):
    return c.findings().select("severity", scoring.severity_label(F.col("severity")).alias("label")).groupBy("severity", "label").agg(F.count(F.lit(1)).alias("n"))


@query("select coalesce(severity, 0) as severity, coalesce(context, 'all') as context, count(*)::bigint as n from findings group by cube (severity, context)", "findings")
def severity_context_cube(c):
    return c.findings().cube("severity", "context").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("severity", F.lit(0)).alias("severity"), F.coalesce("context", F.lit("all")).alias("context"), "n")


@query("select coalesce(repo, 'all') as repo, coalesce(severity, 0) as severity, coalesce(context, 'all') as context, count(*)::bigint as n from findings group by rollup (repo, severity, context)", "findings")
def repo_severity_context_rollup(c):
    got = c.findings().rollup("repo", "severity", "context").agg(F.count(F.lit(1)).alias("n"))
    return got.select(F.coalesce("repo", F.lit("all")).alias("repo"), F.coalesce("severity", F.lit(0)).alias("severity"), F.coalesce("context", F.lit("all")).alias("context"), "n")


@query("select repo, count(*) filter (severity = 1)::bigint as severity_1, count(*) filter (severity = 2)::bigint as severity_2, count(*) filter (severity = 3)::bigint as severity_3, count(*) filter (severity = 4)::bigint as severity_4 from findings group by repo", "findings")
def severity_histogram_by_repo(c):
    return op.histogram(c.findings(), ["repo"], [1, 2, 3, 4], "severity")


_SUPPRESSED = "suppressed as (select hash from triage where status = 'false_positive')"


@query(f"with {_SUPPRESSED} select hash, scan_id, line, part, supp, price from findings where hash not in (select hash from suppressed)", "findings", "triage")
def suppression_split_active(c):
    return op.split_suppressed(c.findings(), c.triage().filter("status = 'false_positive'"))[0].select("hash", "scan_id", "line", "part", "supp", "price")


@query(f"with {_SUPPRESSED} select hash, scan_id, line, part, supp, price from findings where hash in (select hash from suppressed)", "findings", "triage")
def suppression_split_suppressed(c):
    return op.split_suppressed(c.findings(), c.triage().filter("status = 'false_positive'"))[1].select("hash", "scan_id", "line", "part", "supp", "price")


@query("select f.hash, f.scan_id, f.line, f.part, f.supp, f.price, t.status from findings f left join triage t using (hash)", "findings", "triage")
def triage_annotate(c):
    return op.annotate_triage(c.findings(), c.triage()).select("hash", "scan_id", "line", "part", "supp", "price", "status")


@query("""select hash, coalesce(case when mk % 2 = 0 then 'reviewed' end, status) as status from
  (select distinct f.hash, f.mk, t.status from findings f left join triage t using (hash)) where status is not null or mk % 2 = 0""", "findings", "triage")
def triage_upsert(c):
    old = c.triage().withColumn("at", F.lit(1))
    new = c.findings().filter("mk % 2 = 0").select("hash").distinct().select("hash", F.lit("reviewed").alias("status"), F.lit(1).alias("at"))
    return op.upsert(old, new, "hash", "at").select("hash", "status")


_DELTA = f"""cur as (select distinct hash from findings where started_at >= timestamp '{CUT}'), base as (select distinct hash from findings where started_at < timestamp '{CUT}'),
delta as (select coalesce(c.hash, b.hash) as hash, case when b.hash is null then 'new' when c.hash is null then 'fixed' else 'unchanged' end as change from cur c full join base b on c.hash = b.hash)"""


def _delta(c):
    f = c.findings()
    cut = F.lit(CUT).cast("timestamp")
    return op.delta(f.filter(F.col("started_at") >= cut), f.filter(F.col("started_at") < cut))


@query(f"with {_DELTA} select * from delta", "findings")
def delta_classify(c):
    return _delta(c)


@query(f"with {_DELTA} select change, count(*)::bigint as n from delta group by change", "findings")
def delta_counts(c):
    return _delta(c).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query(f"""select distinct hash, file from findings where started_at < timestamp '{CUT}' and file in (select file from findings where started_at >= timestamp '{CUT}' and severity = 1)""", "findings")
def delta_scoped_baseline(c):
    f = c.findings()
    cut = F.lit(CUT).cast("timestamp")
    scanned = f.filter((F.col("started_at") >= cut) & (F.col("severity") == 1))
    return op.scoped_baseline(f.filter(F.col("started_at") < cut), scanned, F.col("file"), F.col("file")).select("hash", "file").distinct()


@query("""select repo, file, count(distinct rule)::bigint as rules, count(*)::bigint as n from findings group by repo, file""", "findings")
def distinct_rules_per_file(c):
    return c.findings().groupBy("repo", "file").agg(F.count_distinct("rule").alias("rules"), F.count(F.lit(1)).alias("n"))


@query("""with k as (select repo, file, count(distinct rule) as corroboration from findings group by repo, file),
lifted as (select *, greatest(5, least(98, round_even(100.0::double / (1.0::double + exp(-(ln(0.35::double / 0.65::double) + case when corroboration between 3 and 4 then 0.6::double when corroboration >= 5 then 0.9::double else 0 end))), 0)::int)) as c from k)
select f.scan_id, f.line, f.part, f.supp, f.price, l.corroboration, case when l.corroboration >= 3 then greatest(f.confidence, l.c) else f.confidence end as confidence
from findings f join lifted l on f.repo = l.repo and f.file = l.file""", "findings")
def corroboration(c):
    return op.corroborated(c.findings(), ["repo", "file"]).select("scan_id", "line", "part", "supp", "price", "corroboration", "confidence")


@query("""with g as (select scan_id, file, min(line) as line, max(case when context = 'production' then 1 else 0 end) as prod,
  list_sort(list(distinct struct_pack(line := line, rule := rule)) filter (category = 'Security')) as s, list_sort(list(distinct struct_pack(line := line, rule := rule)) filter (category <> 'Security')) as u from findings group by scan_id, file)
select scan_id, file, line, array_to_string(list_transform(s[1:2] || u[1:2], lambda x: x.rule), ',') as evidence, case prod when 1 then 1 else 2 end as severity, case prod when 1 then 95 else 88 end as confidence
from g where s is not null and u is not null""", "findings")
def secret_flow_correlation(c):
    return op.secret_flow(c.findings(), F.col("category") == "Security", F.col("category") != "Security", ["scan_id", "file"])


@query("""select a.scan_id, a.file, a.line, count(distinct b.line)::bigint as n_sinks from (select distinct scan_id, file, line from findings where category = 'Security') a
join findings b on a.scan_id = b.scan_id and a.file = b.file and b.line between a.line - 2 and a.line + 12 and b.category <> 'Security' group by all""", "findings")
def band_proximity(c):
    f = c.findings()
    return op.within_lines(f.filter("category = 'Security'").select("scan_id", "file", "line").distinct(), f.filter("category <> 'Security'"), ["scan_id", "file"])


@query("""with t as (select count(*)::bigint as n, floor(least(100.0::double, (count(*) filter (severity = 1) * 100 + count(*) filter (severity = 2) * 70 + count(*) filter (severity = 3) * 35 + count(*) filter (severity = 4) * 10) / count(*)::double))::int as score from findings)
select n, score, case when score >= 70 then 'high' when score >= 35 then 'medium' else 'low' end as band from t""", "findings")
def executive_risk_score(c):
    return op.executive_score(c.findings())


@query("select scan_id, repo, severity, file, line from findings where severity <= 1 and context = 'production' order by severity, repo, scan_id, line, part, supp, price limit 25 offset 25", "findings")
def findings_page_two(c):
    rows = c.findings().filter("severity <= 1 and context = 'production'")
    return op.page(rows, ["severity", "repo", *SEQ], 2).select("scan_id", "repo", "severity", "file", "line")


@query(f"select repo, rule, scan_id, line from findings qualify row_number() over (partition by repo order by severity, {_SEQ}) <= 8", "findings")
def top_examples_per_repo(c):
    return op.rows_by_rank(c.findings(), ["repo"], ["severity", *SEQ], 8).select("repo", "rule", "scan_id", "line")


@query("select list_sort(list(distinct repo)) as repos, list_sort(list(distinct rule)) as rules, list_sort(list(distinct project_key)) as projects from findings", "findings")
def filter_options(c):
    return c.findings().agg(F.array_sort(F.collect_set("repo")).alias("repos"), F.array_sort(F.collect_set("rule")).alias("rules"), F.array_sort(F.collect_set("project_key")).alias("projects"))


@query("select scan_id, line, part, supp, price, md5(concat(repo, '::', file, '::', substr(concat(rule, ' ', context), 1, 120))) as id from findings", "findings")
def stable_ids(c):
    return c.findings().select("scan_id", "line", "part", "supp", "price", stable_id(F.col("repo"), F.col("file"), F.concat(F.lit("  "), "rule", F.lit(" \t "), "context")).alias("id"))


@query("select distinct rule, concat('Rule ', substr(rule, 6)) as label from findings", "findings")
def rule_labels(c):
    return c.findings().select("rule", title_label(F.col("rule"), F.lit("")).alias("label")).distinct()


@query("select project_key, repo, hash from findings where project_key in ('P1', 'P3') group by all", "findings")
def row_level_security(c):
    mine = c.spark.createDataFrame([("P1",), ("P3",)], "project_key string")
    # two rows: a shuffle by project would hold each project's findings in one task
    return c.findings().join(F.broadcast(mine), "project_key", "left_semi").select("project_key", "repo", "hash").distinct()


@query("select repo, file, severity, rule, lower(concat_ws(' ', repo, file, rule, context)) as searched from findings where contains(lower(concat_ws(' ', repo, file, rule, context)), 'rule_1 docs') group by all", "findings")
def free_text_filter(c):
    text = F.lower(F.concat_ws(" ", "repo", "file", "rule", "context"))
    return c.findings().select("repo", "file", "severity", "rule", text.alias("searched")).filter(F.contains("searched", F.lit("rule_1 docs"))).distinct()


@query("select category, list_sort(list(distinct rule)) as rules, count(distinct (repo, file))::bigint as files from findings group by category", "findings")
def threat_counters(c):
    return c.findings().groupBy("category").agg(F.array_sort(F.collect_set("rule")).alias("rules"), F.count_distinct("repo", "file").alias("files"))


@query("""with t as (select distinct lower(concat(rule, ' in ', context)) as title, category, case when category = 'Security' then 'Information disclosure' when category like '%API%' then 'Tampering' else 'Spoofing' end as stride, min(severity) over (partition by rule, context) as severity from findings)
select title, stride, severity from t order by severity, title limit 15""", "findings")
def threat_top15(c):
    title = F.lower(F.concat("rule", F.lit(" in "), "context"))
    stride = F.when(F.col("category") == "Security", "Information disclosure").when(F.contains("category", F.lit("API")), "Tampering").otherwise("Spoofing")
    got = c.findings().groupBy(title.alias("title"), stride.alias("stride")).agg(F.min("severity").alias("severity"))
    return got.orderBy("severity", "title").limit(15)


@query("select scan_id as \"Scan\", repo as \"Repo\", file as \"File\", line as \"Line\", severity as \"Severity\", rule as \"Rule\", round(price, 2) as \"Price\" from findings", "findings")
def csv_projection(c):
    return c.findings().select(F.col("scan_id").alias("Scan"), F.col("repo").alias("Repo"), F.col("file").alias("File"), F.col("line").alias("Line"), F.col("severity").alias("Severity"), F.col("rule").alias("Rule"), F.round("price", 2).alias("Price"))
