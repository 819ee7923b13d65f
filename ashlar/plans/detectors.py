"""Queries of detectors, repository facts and the threat model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facts, rules, threats
from ..sources import files as src
from .bindings import Corpus, oracle

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None, *views: str):
    def keep(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Corpus(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = oracle(sql, *views) if views else sql
        return f

    return keep


_TOKEN, _EMAIL = 'token = "[0-9a-f]{40}"', "[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]+"
FEW = (
    rules.Rule("hardcoded_credential", rules.SEC, "Credential in source", 1, _TOKEN, anchors=("token",)),
    rules.Rule("email_address", "Personal Data", "Mail address", 3, _EMAIL, anchors=("@",)),
)


def _found(source: str, key: str, text: str, pattern: str, rule: str) -> str:
    """SQL of the matches of a pattern: key columns, rule, match, start, line."""
    return f"""(select {key}, '{rule}' as rule, match, (sum(length(gap) + length(match)) over w - length(match))::int as start, (sum(length(gap) - length(replace(gap, chr(10), ''))) over w + 1)::int as line
  from (select {key}, unnest(regexp_extract_all({text}, '{pattern}')) as match, unnest(string_split_regex({text}, '{pattern}')[1:len(regexp_extract_all({text}, '{pattern}'))]) as gap, generate_subscripts(regexp_extract_all({text}, '{pattern}'), 1) as n
  from {source} where regexp_matches({text}, '{pattern}')) window w as (partition by {key} order by n))"""


@query(rf"""with cells as (select concat('n', doc_id, '.ipynb::cell[1]') as path, regexp_replace(text, '(^|\n|[ \t])#[^\n]*', '\1', 'g') as code, concat('shown: ', text) as shown from documents)
select path, rule, line, match, false as in_output from {_found("cells", "path", "code", _TOKEN, "hardcoded_credential")} union all select path, rule, line, match, false from {_found("cells", "path", "code", _EMAIL, "email_address")}
union all select path, rule, line, match, true from {_found("cells", "path", "shown", _TOKEN, "hardcoded_credential")}""")
def notebook_findings(c):
    """Documents as notebooks of one cell, read back from their JSON."""
    cell = F.struct(F.lit("code").alias("cell_type"), F.col("text").alias("source"), F.array(F.struct(F.concat(F.lit("shown: "), "text").alias("text"))).alias("outputs"))
    books = c.table("documents").select(F.col("source").alias("repo"), F.concat(F.lit("n"), "doc_id", F.lit(".ipynb")).alias("path"), F.to_json(F.struct(F.array(cell).alias("cells"))).alias("content"))
    return rules.notebook_findings(src.notebook_cells(books), FEW).select("path", "rule", "line", "match", "in_output")


@query(f"""with f as (select concat('static/d', doc_id, '.min.js') as path, text from documents)
select path, start, match, case when match like 'token = %' then 1 else 2 end as severity from {_found("f", "path", "text", f"{_TOKEN}|{_EMAIL}", "any")}""")
def minified_findings(c):
    files = c.table("documents").select(F.col("source").alias("repo"), F.concat(F.lit("static/d"), "doc_id", F.lit(".min.js")).alias("path"), F.col("text").alias("content"))
    return rules.bundle_findings(files, _TOKEN, _EMAIL).select("path", "start", "match", "severity")


@query(f"""with log as (select source as repo, doc_id as position, concat('c', doc_id % 97) as commit, concat('notes/d', doc_id % 300, '.md') as path, text from documents),
kept as (select repo, path, arg_min(commit, struct_pack(a := position, b := commit)) as commit from log group by repo, path),
f as (select distinct repo, path, commit, text from log join kept using (repo, path, commit) where length(text) > 0)
select repo, path, commit, rule, line, match, 1 as severity, 'CRITICAL' as policy_status from {_found("f", "repo, path, commit, text", "text", _TOKEN, "hardcoded_credential")}
union all select repo, path, commit, rule, line, match, 3, 'REVIEW' from {_found("f", "repo, path, commit, text", "text", _EMAIL, "email_address")}""")
def deleted_file_findings(c):
    log = c.table("documents").select(F.col("source").alias("repo"), F.col("doc_id").alias("position"), F.concat(F.lit("c"), F.col("doc_id") % 97).alias("commit"), F.concat(F.lit("notes/d"), F.col("doc_id") % 300, F.lit(".md")).alias("path"), F.col("text").alias("content"))
    return rules.deleted_file_findings(src.deleted_files(log, None, None).distinct(), FEW).select("repo", "path", "commit", "rule", "line", "match", "severity", "policy_status")


@query("""with made as (select distinct concat('repo_', s_suppkey % 50) as repo, concat('m', s_suppkey, '.py') as source, concat('client_', s_suppkey % 7) as name, case s_suppkey % 3 when 0 then 'openai' when 1 then 'anthropic' else 'groq' end as provider from supplier),
used as (select concat('repo_', c_custkey % 50) as repo, concat('c', c_custkey, '.py') as path, concat('client_', c_custkey % 7) as name from customer where c_custkey % 5 <> 0)
select repo, path, 2 as line, name, provider, source from used join made using (repo, name)""")
def cross_file_clients(c):
    k = F.col("s_suppkey")
    ctor = F.when(k % 3 == 0, "OpenAI").when(k % 3 == 1, "Anthropic").otherwise("Groq")
    made = c.table("supplier").select(F.concat(F.lit("repo_"), k % 50).alias("repo"), F.concat(F.lit("m"), k, F.lit(".py")).alias("path"), F.concat(F.lit("x = 1\nclient_"), k % 7, F.lit(" = "), ctor, F.lit("()\n")).alias("content"))
    k = F.col("c_custkey")
    call = F.when(k % 5 == 0, "pass").otherwise("out = client.create(x)")
    used = c.table("customer").select(F.concat(F.lit("repo_"), k % 50).alias("repo"), F.concat(F.lit("c"), k, F.lit(".py")).alias("path"), F.concat(F.lit("import os\nfrom m import client_"), k % 7, F.lit("\n"), call).alias("content"))
    return rules.cross_file_clients(made.unionByName(used)).select("repo", "path", "line", "name", "provider", "source")


@query("""with f as (select concat('r', p_partkey % 10) as repo, p_partkey as k from part), n as (select max(k) as most from f),
py as (select a.repo, concat('app/m', a.k, '.py') as src, concat('app/m', a.k + 10, '.py') as dst from f a join f b on b.repo = a.repo and b.k = a.k + 10), js as (select a.repo, concat('web/ui/c', a.k, '.js') as src, concat('web/lib/c', a.k - 10, '.js') as dst from f a join f b on b.repo = a.repo and b.k = a.k - 10)
select * from py union all select * from js""")
def import_edges(c):
    k = F.col("p_partkey")
    repo = F.concat(F.lit("r"), k % 10).alias("repo")
    name = lambda a, n, b: F.concat(F.lit(a), n, F.lit(b))
    py = c.table("part").select(repo, name("app/m", k, ".py").alias("path"), name("from app.m", k + 10, " import run\n").alias("content"))
    ui = c.table("part").select(repo, name("web/ui/c", k, ".js").alias("path"), name("import x from '../lib/./c", k - 10, "'\n").alias("content"))
    lib = c.table("part").select(repo, name("web/lib/c", k, ".js").alias("path"), F.lit("export default 1").alias("content"))
    return facts.import_edges(py.unionByName(ui).unionByName(lib))


@query(r"""with f as (select concat('r', page_id % 20) as repo, concat('src/p', page_id, '.py') as path, lower(regexp_extract(url, 'https?://([A-Za-z0-9.-]+)', 1)) as host from pages where regexp_matches(url, 'https?://[A-Za-z0-9.-]+'))
select repo, n::int as n, concat(path, ' -> ', host) as example from (select *, row_number() over (partition by repo order by path, host) as n from f) where n <= 8""")
def service_calls(c):
    files = c.table("pages").select(F.concat(F.lit("r"), F.col("page_id") % 20).alias("repo"), F.concat(F.lit("src/p"), "page_id", F.lit(".py")).alias("path"), F.concat(F.lit("u = '"), "url", F.lit("'")).alias("content"))
    return facts.service_calls(files)


@query("""with f as (select concat('r', c_custkey % 9) as repo, concat(case c_custkey % 4 when 0 then 'src/db/c' when 1 then 'src/ui/c' when 2 then 'src/svc/c' else 'models/c' end, c_custkey, '.py') as path, c_custkey % 4 as k from customer where c_custkey % 3 = 0),
v as (select repo, path, 'outside_db_module' as kind from f where k in (1, 2) union all select repo, path, 'in_ui_module' from f where k = 1)
select repo, kind, path from (select *, row_number() over (partition by repo, kind order by path) as n from v) where n <= 8""")
def layer_violations(c):
    k = F.col("c_custkey")
    place = F.when(k % 4 == 0, "src/db/c").when(k % 4 == 1, "src/ui/c").when(k % 4 == 2, "src/svc/c").otherwise("models/c")
    code = F.when(k % 3 == 0, "engine = create_engine(url)").otherwise("pass")
    return facts.layer_violations(c.table("customer").select(F.concat(F.lit("r"), k % 9).alias("repo"), F.concat(place, k, F.lit(".py")).alias("path"), code.alias("content")))


@query("""select repo, case when path like '%.py' then 'Python' when path like '%.js' then 'JavaScript' when path like '%.md' then 'Markdown' else 'YAML' end as language, count(*)::bigint as files from files group by all""", "files")
def languages(c):
    return c.files().groupBy("repo", facts.language(F.col("path")).alias("language")).agg(F.count(F.lit(1)).alias("files"))


@query("""select p_partkey, case p_size % 3 when 0 then p_size::double when 1 then p_size / 1000.0::double end as billions, case when p_size % 5 = 0 then 600 when p_size % 3 = 0 and p_size >= 14 then 360 else 180 end as timeout from part""")
def model_sizes(c):
    size = F.col("p_size")
    name = F.concat(F.when(size % 5 == 0, "qwq-").otherwise("llama-"), size, F.when(size % 3 == 0, "b").when(size % 3 == 1, "m").otherwise("x"), F.lit("-chat"))
    rows = c.table("part").select("p_partkey", name.alias("model"))
    billions = facts.model_billions(F.col("model"))
    return rows.select("p_partkey", billions.alias("billions"), facts.request_timeout(F.col("model"), billions).alias("timeout"))


@query("""select o_orderkey, case when o_orderkey % 3 = 0 then epoch(o_orderdate)::bigint else 0 end as epoch, case o_orderkey % 3 when 0 then strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') when 1 then 'soon' else '' end as raw, epoch(o_orderdate)::bigint as at from orders""")
def record_dates(c):
    k, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    text = F.date_format(at, "yyyy-MM-dd HH:mm:ss")
    rows = c.table("orders").select("o_orderkey", F.when(k % 3 == 0, text).when(k % 3 == 1, "soon").alias("started"), F.when(k % 3 == 1, text).alias("completed"), F.concat(F.lit("scan_"), F.date_format(at, "yyyyMMdd_HHmmss")).alias("scan_id"))
    safe = facts.safe_datetime(F.col("started"))
    return rows.select("o_orderkey", safe["epoch"].alias("epoch"), safe["raw"].alias("raw"), F.unix_seconds(facts.record_datetime(F.col("started"), F.col("completed"), F.col("scan_id"))).alias("at"))


@query("""select c_custkey, case when lower(c_mktsegment) like 'mach%' or lower(c_mktsegment) like '%hold' then 'internal' else 'external' end as scope, lower(replace(replace(c_name, '_', '-'), '.', '-')) as token from customer""")
def dependency_scopes(c):
    return c.table("customer").select("c_custkey", facts.dependency_scope(F.col("c_mktsegment"), ("MACH",), ("hold",)).alias("scope"), facts.repo_token(F.concat(F.lit("group/"), "c_name", F.lit("/"))).alias("token"))


@query("""select source as repo, marker, count(*)::bigint as files from (select source, unnest(list_filter([case when contains(lower(text), 'license') then 'licence' end, case when contains(lower(text), 'token =') then 'token' end], lambda x: x is not null)) as marker from documents) group by all""")
def sdk_markers(c):
    return facts.markers(c.files(), {"licence": "License", "token": "token ="})


@query("""select distinct concat('r', c_custkey) as repo, concat(n, ' on ', r, ' ', printf('%.1f', v)) as label from (select c_custkey, unnest([{'n': 'django', 'r': 'python', 'l': 3.8::double}, {'n': 'next', 'r': 'node', 'l': 18.0::double}], recursive := true), case when c_custkey % 2 = 0 then 'python' else 'node' end as has, (c_custkey % 40 / 2.0)::double as v from customer) where has = r and v < l""")
def old_runtime_frameworks(c):
    k = F.col("c_custkey")
    repo = F.concat(F.lit("r"), k).alias("repo")
    declared = c.table("customer").select(repo, F.explode(F.array(F.lit("django"), F.lit("next"), F.lit("flask"))).alias("name"))
    return facts.old_runtime_frameworks(declared, c.table("customer").select(repo, F.when(k % 2 == 0, "python").otherwise("node").alias("runtime"), (k % 40 / 2.0).alias("version")))


@query("select event_id, strftime(ts, '[%H:%M:%S] ') || event_type as line from events")
def log_lines_formatted(c):
    return c.table("events").select("event_id", facts.log_line(F.col("ts").cast("timestamp"), F.col("event_type")).alias("line"))


@query("select scan_id, repo, state from scans where repo = 'repo_7' and state = 'done' and contains(lower(concat_ws(' ', scan_id, repo, state)), '77')", "scans")
def history_filter(c):
    return facts.history_filter(c.scans().select("scan_id", "repo", "state"), "77", repo="repo_7", state="done")


@query("select concat('P_a_', max(printf('%08d', o_orderkey)), '.csv') as name from orders where o_orderkey % 2 = 0")
def newest_baseline(c):
    k = F.col("o_orderkey")
    names = F.concat(F.when(k % 2 == 0, "P_a_").otherwise("P_a_b_"), F.format_string("%08d", k), F.lit(".csv"))
    return facts.newest_baseline(c.table("orders").select(names.alias("name")), "P", "a")


@query("select repo, path from files where doc_id in (select doc_id from labels where quality = 1)", "files")
def rescan_scope(c):
    good = c.table("labels").filter("quality = 1").select("doc_id").distinct()
    changed = c.files().join(good, "doc_id", "left_semi").select("repo", "path")
    return facts.rescan_scope(changed, c.files()).select("repo", "path")


_STRIDE = """case when regexp_matches(w, '(?i)credential|key|token|secret') then 'Information disclosure' when regexp_matches(w, '(?i)exec|eval|pickle|remote_code') then 'Elevation of privilege' when regexp_matches(w, '(?i)sql|prompt|injection|jailbreak') then 'Tampering'
  when regexp_matches(w, '(?i)log|debug') then 'Repudiation' when regexp_matches(w, '(?i)api|http|endpoint|gateway|proxy') then 'Spoofing' else 'Denial of service' end"""


@query(f"""select concat('threat_', substr(sha1(concat_ws('|', repo, file, rule)), 1, 12)) as id, repo, file, rule, {_STRIDE} as stride, min(severity) as severity from (select *, concat_ws(' ', rule, category) as w from findings) group by repo, file, rule, w""", "findings")
def finding_threats(c):
    return threats.finding_threats(c.findings()).drop("mitigation")


_HELD = """h as (select repo, count(*) filter (category = 'Security') > 0 as sec, count(*) filter (category like 'External%') > 0 as ext, count(*) filter (category like 'RAG%') > 0 as rag, count(*) filter (context = 'production') > 10 as prod, count(*) filter (severity = 1) > 0 as crit, count(*) as n from findings group by repo)"""


@query(f"""with {_HELD} select repo, title, stride from (select repo, unnest([{{'title': 'Secrets in code', 'stride': 'Information disclosure', 'ok': sec}}, {{'title': 'Calls to hosted models', 'stride': 'Spoofing', 'ok': ext}}, {{'title': 'Retrieved text reaches a model', 'stride': 'Tampering', 'ok': rag}},
  {{'title': 'Many findings in production', 'stride': 'Elevation of privilege', 'ok': prod}}, {{'title': 'Secrets beside hosted models', 'stride': 'Information disclosure', 'ok': sec and ext}}, {{'title': 'Critical findings', 'stride': 'Elevation of privilege', 'ok': crit}}], recursive := true) from h) where ok""", "findings")
def architecture_threats(c):
    return threats.architecture_threats(c.findings())


@query(f"""with {_HELD} select repo, concat('{{"cells":[{{"kind":"actor","name":"User"}},{{"kind":"process","name":"', repo, '"}}', case when rag then ',{{"kind":"store","name":"Vector store"}}' else '' end, case when ext then ',{{"kind":"actor","name":"Hosted model"}}' else '' end,
  '],"flows":[{{"from":"User","to":"', repo, '"}}', case when rag then concat(',{{"from":"', repo, '","to":"Vector store"}}') else '' end, case when ext then concat(',{{"from":"', repo, '","to":"Hosted model"}}') else '' end, '],"boundary":["', repo, '"', case when rag then ',"Vector store"' else '' end, '],"threats":', n, '}}') as diagram from h""", "findings")
def threat_diagram(c):
    return threats.diagram(c.findings())
