"""Queries over scans as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import scan as op
from ..sources.shared import written
from .bindings import Corpus, registry
from .detectors import _EMAIL, _TOKEN, FEW
from .flows import _BITS, _DIGITS, _SINK, _WORD, SOURCES, _places

QUERIES, ORACLES, query = registry()


def _found(c: Corpus) -> DataFrame:
    """Every text is code here, as the files of the tables are prose; docs/ is ignored. No query returns snippets."""
    return op.scan(c.files(), FEW, SOURCES, _SINK, "(?i)released|licensed|est|ist", ("docs/",), 3.5, ("hardcoded_credential",), ("Personal Data",), r"\.", snippets=False, stripped=False)


def _id(*parts: str) -> str:
    return f"md5(concat_ws('::', repo, path, {', '.join(parts)}))"


_NORMAL = "left(trim(regexp_replace(match, '\\s+', ' ', 'g')), 120)"
_RULES = "case rule when 'hardcoded_credential' then 'Security' when 'email_address' then 'Personal Data' when 'digits_to_sink' then 'Personal Data' else 'Security' end"
#: Confidence of a rule's match by its evidence, and what several rules in a file lift it to.
_SURE = "greatest(5, least(98, round_even(100.0::double / (1.0::double + exp(-(ln(0.35::double / 0.65::double) {0}))), 0)::int))"
_SIGNALS = """+ case when category = 'Security' then 0.65::double else 0 end + case when regexp_matches(match, '\\w+\\s*[=:]\\s*\\S') then 0.9::double else 0 end + case when length(match) >= 20 then 0.3::double else 0 end
  + case when length(match) <= 6 then -0.4::double else 0 end + case when context = 'test' then -1.4::double else 0 end + case when context = 'docs' then -0.8::double else 0 end"""
_SCAN = f"""code as (
  select repo, path, content, case when path like 'tests/%' then 'test' when path like '%.md' then 'docs' else 'production' end as context from files
  where path not like 'docs/%' and not (path like '%.js' and (list_max(list_transform(string_split(content, chr(10))[1:5], lambda x: length(x) + 1)) > 1001 or list_avg(list_transform(string_split(content, chr(10))[1:5], lambda x: length(x) + 1)) > 501))
), {_BITS.replace("files", "code")}, hits as (
  select repo, path, 'rule' as detector, 0 as o, 'hardcoded_credential' as rule, 1 as base, line, start, match from {_places("(select * from code where path not like '%.yaml')", "repo, path", "content", _TOKEN)}
  union all select repo, path, 'rule', 0, 'email_address', 3, line, start, match from {_places("(select * from code where path not like '%.yaml')", "repo, path", "content", _EMAIL)}
), sinks as (
  select distinct repo, path, line as sink from {_places("code", "repo, path", "content", _SINK)}
), sources as (
  select repo, path, 0 as ordinal, start, line, match from {_places("code", "repo, path", "content", _WORD)}
  union all select repo, path, 1, start, line, match from {_places("(select * from code where regexp_matches(content, '(?i)the|der|les|los'))", "repo, path", "content", _DIGITS)}
), flows as (
  select h.*, row_number() over (partition by repo, path, {_NORMAL} order by ordinal, start) as k from sources h where exists (select 1 from sinks s where s.repo = h.repo and s.path = h.path and s.sink between h.line - 2 and h.line + 12)
), each as (
  select h.repo, h.path, detector, rule, {_RULES} as category, least(base + case when context in ('test', 'docs') then 2 else 0 end, 4) as severity, context, line, start, match, {_id("match").replace("match)", _NORMAL + ")")} as id, 1 as o from hits h join code using (repo, path)
  union all select k.repo, k.path, 'entropy', 'entropy_secret', 'Security', least(1 + case when context in ('test', 'docs') then 2 else 0 end, 4), context, line, start, value, md5(concat_ws('::', k.repo, k.path, 'bits', left(value, 120))), 3 from k join code using (repo, path) where n = 1
  union all select f.repo, f.path, 'flow', case ordinal when 0 then 'word_to_sink' else 'digits_to_sink' end, case ordinal when 0 then 'Security' else 'Personal Data' end, least(2 + ordinal + case when context = 'test' then 2 else 0 end, 4), case context when 'test' then 'test' else 'production' end, line, 0, match,
    {_id("'ml'", "match").replace("match)", _NORMAL + ")")}, 4 from flows f join code using (repo, path) where k = 1
), sure as (
  select *, case detector when 'rule' then {_SURE.format(_SIGNALS)} when 'entropy' then 75 else 70 end as c0, case when detector = 'flow' then case when category = 'Security' then 'CRITICAL' else 'REVIEW' end when category = 'Security' then 'CRITICAL' else 'REVIEW' end as p0 from each
), counted as (
  select repo, path, count(distinct rule) as corroboration from each group by repo, path
), lifted as (
  select s.*, corroboration::bigint as corroboration, case when corroboration >= 3 then greatest(c0, {_SURE.format("+ case when corroboration between 3 and 4 then 0.6::double else 0.9::double end")}) else c0 end as confidence from sure s join counted using (repo, path)
), places as (
  select *, row_number() over (partition by repo, path, kind order by line, rule) as k from (select distinct repo, path, line, rule, case when rule = 'hardcoded_credential' then 's' else 'u' end as kind from each where rule = 'hardcoded_credential' or category = 'Personal Data')
), both_ as (
  select repo, path, string_agg(rule, ',' order by kind, k) filter (k <= 2) as evidence from places group by repo, path having bool_or(kind = 's') and bool_or(kind = 'u')
), correlated as (
  select b.repo, b.path, evidence, (select min(line) from each e where e.repo = b.repo and e.path = b.path) as line, context, regexp_extract(content, '((?i)released|licensed|est|ist)', 1) as signal, (select max(case when e.context = 'production' then 1 else 0 end) from each e where e.repo = b.repo and e.path = b.path) as prod
  from both_ b join code using (repo, path) where regexp_matches(content, '(?i)released|licensed|est|ist')
), every as (
  select repo, path, detector, rule, category, severity, context, line, start, match, id, confidence, p0 as status, corroboration, o from lifted
  union all select repo, path, 'correlation', 'secret_ai_correlation', 'Security', case prod when 1 then 1 else 2 end, context, line, 0, evidence, md5(concat_ws('::', repo, path, 'secret-ai', evidence, left(signal, 120))), case prod when 1 then 95 else 88 end, case prod when 1 then 'CRITICAL' else 'REVIEW' end, 1, 7 from correlated
), once as (
  select * from every qualify row_number() over (partition by id order by o, line, start, rule, match, severity) = 1
)"""


@query(f"with {_SCAN} select repo, path, detector, rule, category, severity, context, line, match, id, confidence, status as policy_status, corroboration from once", "files")
def scan_all(c):
    """Rules, literals of many bits, flows and secrets beside models over all files, made unique."""
    return _found(c).select("repo", "path", "detector", "rule", "category", "severity", "context", "line", "match", "id", "confidence", "policy_status", "corroboration")


@query(f"""with {_SCAN}, ruled as (
  select *, case when rule = 'hardcoded_credential' or category = 'Security' and context = 'production' then 'CRITICAL' when category = 'Security' then 'REVIEW' when status in ('CRITICAL', 'DENIED', 'ALLOWED') then status else 'REVIEW' end as judged,
    case when rule = 'hardcoded_credential' or category = 'Security' and context = 'production' then 1 when category = 'Security' then greatest(severity, 3) else severity end as sev from once
)
select repo, path, id, rule, sev as severity, judged as policy_status, 'Sev-' || sev || ' (' || case sev when 1 then 'Critical' when 2 then 'High' when 3 then 'Medium' else 'Low' end || ')' as severity_label,
  case when left(id, 1) < '8' then 'unchanged' else 'new' end as delta_status, case when left(id, 1) in ('3', 'c') then 'false_positive' end as triage_status from ruled""", "files")
def scan_judged(c):
    """The scan with policy, labels, triage and delta; half of the ids were in the scan before."""
    found = written(_found(c), "scan")
    ids = found.select("id")
    before = ids.filter(F.substring("id", 1, 1) < "8")
    triage = ids.filter(F.substring("id", 1, 1).isin("3", "c")).select(F.col("id").alias("hash"), F.lit("false_positive").alias("status")).distinct()
    got = op.judged(found, c.lists(), triage, before)
    return got.select("repo", "path", "id", "rule", "severity", "policy_status", "severity_label", "delta_status", "triage_status")
