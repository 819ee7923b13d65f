"""Queries of flows over lines, symbol tables, notebooks and literals of many bits."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import flow, rules, symbols
from .bindings import Corpus, registry
from .detectors import FEW

QUERIES, ORACLES, query = registry()

_EMAIL, _DIGITS = "[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]+", "[0-9]{16}"
_WORD, _SINK = "[a-z]+(?:nder|chen|ment)s?", " (?:be|sich|pas|que) "


def _places(source: str, key: str, text: str, pattern: str) -> str:
    """SQL of the matches of a pattern: key columns, match, n, start, line."""
    return f"""(select {key}, match, n, (sum(length(gap) + length(match)) over w - length(match))::int as start, (sum(length(gap) - length(replace(gap, chr(10), ''))) over w + 1 + sum(length(match) - length(replace(match, chr(10), ''))) over w - (length(match) - length(replace(match, chr(10), ''))))::int as line
  from (select {key}, unnest(regexp_extract_all({text}, '{pattern}')) as match, unnest(string_split_regex({text}, '{pattern}')[1:len(regexp_extract_all({text}, '{pattern}'))]) as gap, generate_subscripts(regexp_extract_all({text}, '{pattern}'), 1) as n
  from {source} where regexp_matches({text}, '{pattern}')) window w as (partition by {key} order by n))"""


SOURCES = (rules.Rule("word_to_sink", rules.SEC, "A long word", 2, _WORD), rules.Rule("digits_to_sink", "Personal Data", "Sixteen digits", 3, _DIGITS, guard="(?i)the|der|les|los"))


@query(f"""with hits as (select repo, path, 0 as ordinal, start, line, match from {_places("files", "repo, path", "content", _WORD)} union all
    select repo, path, 1, start, line, match from {_places("(select * from files where regexp_matches(content, '(?i)the|der|les|los'))", "repo, path", "content", _DIGITS)}),
sinks as (select distinct repo, path, line as sink from {_places("files", "repo, path", "content", _SINK)}),
kept as (select h.*, row_number() over (partition by repo, path, substr(trim(match), 1, 120) order by ordinal, start) as k from hits h where exists (select 1 from sinks s where s.repo = h.repo and s.path = h.path and s.sink between h.line - 1 and h.line + 0))
select repo, path, case ordinal when 0 then 'word_to_sink' else 'digits_to_sink' end as rule, least(2 + ordinal + case when path like 'tests/%' then 2 else 0 end, 4) as severity, line, match,
  case when path like 'tests/%' then 'test' else 'production' end as context, case ordinal when 0 then 'CRITICAL' else 'REVIEW' end as policy_status from kept where k = 1""", "files")
def data_flows(c):
    """Words and long numbers with a sink on their line or the one above; one a text and file."""
    got = flow.data_flows(c.files(), SOURCES, _SINK, 1, 0, stripped=False)
    return got.select("repo", "path", "rule", "severity", "line", "match", "context", "policy_status")


@query(f"""with found as (select repo, path, 's' as kind, line, 'hardcoded_credential' as rule from {_places("files", "repo, path", "content", 'token = "[0-9a-f]{40}"')} union all select repo, path, 'u', line, 'email_address' from {_places("files", "repo, path", "content", _EMAIL)}),
places as (select *, row_number() over (partition by repo, path, kind order by line, rule) as k from (select distinct repo, path, kind, line, rule from found)),
both_ as (select repo, path, min(line) as line, bool_or(kind = 's') and bool_or(kind = 'u') as ok, string_agg(rule, ',' order by kind, k) filter (k <= 2) as evidence from places group by repo, path)
select b.repo, b.path, b.line, b.evidence, case when b.path like 'tests/%' or b.path like 'docs/%' or b.path like '%.md' then 2 else 1 end as severity, case when b.path like 'tests/%' or b.path like 'docs/%' or b.path like '%.md' then 88 else 95 end as confidence,
  regexp_extract(f.content, '((?i)released|licensed|est|ist)', 1) as signal from both_ b join files f using (repo, path) where b.ok and regexp_matches(f.content, '(?i)released|licensed|est|ist')""", "files")
def secret_beside_model(c):
    """Files with a token, a mail address and a word that stands for the handling of prompts."""
    found = rules.detect(c.files(), tuple(replace(r, config_only=None) for r in FEW), stripped=False).select("repo", "path", "rule", "line", "context")
    return flow.secret_beside_model(found, c.files(), F.col("rule") == "hardcoded_credential", F.col("rule") == "email_address", "(?i)released|licensed|est|ist")


def _code(c: Corpus) -> DataFrame:
    """Lines of code, twelve parts a file: constructors and calls that the parts' numbers name."""
    k = F.col("p_partkey")
    var = F.concat(F.lit("v"), (k % 5).cast("string"))
    made = F.element_at(F.array(*[F.lit(x) for x in ("OpenAI(", "groq.Groq (", "cohere.Client(", "new OpenAI(", "litellm.x(", "anthropic.Anthropic(")]), (k % 6 + 1).cast("int"))
    method = F.element_at(F.array(*[F.lit(x) for x in ("chat.completions.create", "invoke", "Messages.Create", "close", "stream")]), (F.floor(k / 3) % 5 + 1).cast("int"))
    line = F.when(k % 3 == 0, F.concat(var, F.lit(" = "), made, F.lit(")"))).otherwise(F.concat(F.lit("r = "), var, F.lit("."), method, F.lit("(x)")))
    return c.table("part").select(k.alias("part"), F.floor(k / 12).alias("file"), (k % 12).alias("at"), line.alias("line"))


def _files(c: Corpus) -> DataFrame:
    rows = _code(c).groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("content"))
    return rows.select(F.lit("r").alias("repo"), F.concat(F.lit("f"), F.col("file").cast("string"), F.lit(".py")).alias("path"), "content")


_CODE = """code as (
  select p_partkey as k, p_partkey // 12 as file, p_partkey % 12 as pos, 'v' || (p_partkey % 5) as var, p_partkey % 3 = 0 as made, [9, null, 5, 13, 11, 3][p_partkey % 6 + 1] as ordinal,
    [ 'openai', null, 'cohere', 'openai_js', 'litellm', 'anthropic'][p_partkey % 6 + 1] as provider, ['chat.completions.create', 'invoke', 'Messages.Create', null, 'stream'][p_partkey // 3 % 5 + 1] as method from part
)"""


@query(f"""with {_CODE}, bound as (select file, var, arg_max(provider, struct_pack(a := ordinal, b := pos)) as provider from code where made and provider is not null group by file, var)
select 'r' as repo, 'f' || c.file || '.py' as path, c.var, c.method, b.provider, (c.pos + 1)::int as line from code c join bound b using (file, var) where not c.made and c.method is not null""")
def symbol_calls(c):
    """Calls on clients; of several constructors of a variable the last in the table's order counts."""
    return symbols.tracked_calls(_files(c), ["repo", "path"]).drop("match")


@query(f"""with {_CODE}, bound as (select file, pos, var, provider from code where made and provider is not null)
select 'f' || c.file || '.ipynb' as path, (c.pos + 1)::int as cell, c.var, c.method, arg_max(b.provider, b.pos) as provider from code c join bound b on b.file = c.file and b.var = c.var and b.pos < c.pos where not c.made and c.method is not null group by c.file, c.pos, c.var, c.method""")
def notebook_symbol_calls(c):
    """Calls in notebooks whose cells run one after another: the latest constructor before the call counts."""
    cells = _code(c).select(F.lit("r").alias("repo"), F.concat(F.lit("f"), F.col("file").cast("string"), F.lit(".ipynb")).alias("path"), (F.col("at") + 1).cast("int").alias("cell"), F.col("line").alias("content"))
    return symbols.tracked_calls(cells, ["repo", "path", "cell"], order=F.col("cell"), scope=["repo", "path"]).drop("repo", "line", "match")


_LITERAL = r"""["''][^"''\s]{20,120}["'']"""
_SUSPECT = "(?i)password|passwd|secret|token|api_?key|credential|private_?key"


_BITS = rf"""v as (select p.repo, p.path, p.start, p.line, substr(p.match, 2, length(p.match) - 2) as value, substr(f.content, greatest(p.start - 199, 1), length(p.match) + 400) as near
  from {_places("files", "repo, path, content", "content", _LITERAL)} p join files f using (repo, path)),
k as (select *, row_number() over (partition by repo, path, line order by start) as n from v where len(list_distinct(string_split(value, ''))) >= 6 and list_entropy(string_split(value, '')) >= 3.5 and regexp_matches(near, '{_SUSPECT}'))"""


@query(f"with {_BITS} select repo, path, line, start, value from k where n = 1", "files")
def entropy_literals(c):
    """Quoted literals of 3.5 bits and more near a credential name, the first of each line."""
    return rules.high_entropy(c.files(), 3.5)


@query(f"with {_BITS} select value, length(value)::int as chars, count(distinct (repo, path))::bigint as files from k where n = 1 group by value", "files")
def entropy_values(c):
    """The different literals, and how many files hold each."""
    return rules.high_entropy(c.files(), 3.5).groupBy("value").agg(F.length("value").alias("chars"), F.count_distinct("repo", "path").alias("files"))
