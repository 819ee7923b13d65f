"""Queries over files, pages, events and conversations: detectors, hosts, logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import catalogue, logs, rules, web
from ..operators.findings import first_wins
from .bindings import Corpus, oracle

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None, *views: str):
    def keep(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Corpus(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = oracle(sql, *views) if views else sql
        return f

    return keep


def _rules_sql(catalogue: tuple[rules.Rule, ...] = rules.RULES, source: str = "files") -> str:
    """Rules as SQL over ``source``; noise patterns need code, which these texts do not hold."""
    q = lambda p: p.replace("'", "''")
    parts = []
    for i, r in enumerate(catalogue):
        path = "kind <> 'code'" if r.config_only else "kind <> 'config'"
        anchors = " or ".join(f"contains(lower(code), '{q(a)}')" for a in r.anchors) or "true"
        guard = f"and regexp_matches(code, '{q(r.guard)}')" if r.guard else ""
        found = f"""select repo, path, {i} as ordinal, '{r.slug}' as rule, '{r.category}' as category, {r.severity} as base, n, unnest(regexp_extract_all(code, '{q(r.pattern)}')) as match, unnest(string_split_regex(code, '{q(r.pattern)}')[1:len(regexp_extract_all(code, '{q(r.pattern)}'))]) as gap,
  generate_subscripts(regexp_extract_all(code, '{q(r.pattern)}'), 1) as k from text where {path} and ({anchors}) {guard} and regexp_matches(code, '{q(r.pattern)}')"""
        found = f"select *, (sum(length(gap) - length(replace(gap, chr(10), ''))) over w + coalesce(sum(length(match) - length(replace(match, chr(10), ''))) over (partition by n order by k rows between unbounded preceding and 1 preceding), 0) + 1)::int as line from ({found}) window w as (partition by n order by k)"
        value = f"regexp_extract(match, '{q(rules.VALUE)}', 1)"
        parts.append(f"select * from ({found})" + (f" where {value} <> '' and not regexp_matches({value}, '{q(rules.PLACEHOLDER)}') and list_entropy(string_split({value}, '')) >= 3.0" if r.entropy else ""))
    joined = "\nunion all ".join(parts)
    return rf"""with text as (select repo, path, row_number() over () as n, case when path like '%.py' or path like '%.js' then 'code' when path like '%.yaml' then 'config' else 'other' end as kind,
  case when path like '%.py' then regexp_replace(regexp_replace(content, '(?s)["]{{3}}.*?["]{{3}}|''{{3}}.*?''{{3}}', ' ', 'g'), '(^|\n|[ \t])#[^\n]*', '\1', 'g')
    when path like '%.js' then regexp_replace(regexp_replace(content, '(?s)/\*.*?\*/', ' ', 'g'), '(?m)(?:^|[^:"''\\\n])//[^\n]*', ' ', 'g') else content end as code from {source}),
hits as ({joined}),
placed as (select *, case when path like 'tests/%' then 'test' when path like 'docs/%' or path like '%.md' then 'docs' else 'production' end as context from hits)
select repo, path, ordinal, rule, category, context, least(4, base + case when context = 'production' then 0 else 2 end)::int as severity, line, match, md5(concat(repo, '::', path, '::', substr(trim(regexp_replace(match, '\s+', ' ', 'g')), 1, 120))) as id, k from placed"""


_RULES_SQL = _rules_sql()
_FOUND = ["repo", "path", "ordinal", "rule", "category", "context", "severity", "line", "match", "id"]


@query(f"select {', '.join(_FOUND)} from ({_RULES_SQL})", "files")
def rule_findings(c):
    """Every rule of the catalogue over all files."""
    return rules.detect(c.files()).select(*_FOUND)


@query(f"select {', '.join(_FOUND)} from ({_RULES_SQL}) qualify row_number() over (partition by id order by repo, path, ordinal, k) = 1", "files")
def rule_findings_deduped(c):
    return first_wins(rules.detect(c.files()).select(*_FOUND, "start"), "id", ["repo", "path", "ordinal", "start"]).select(*_FOUND)


#: Lines of code that the texts of the next query end with, two each by their number.
CODE_LINES = (
    "import openai", "agent = A(max_iterations=None, tools=all_tools)", "c = AzureOpenAI(x)", "e = HuggingFaceEmbeddings()", "r = db.as_retriever()", "m = onnx.load(p)", "m = mlflow.pyfunc.load_model(u)", "m = joblib.load(p)",
    "os.system(response)", "exec(completion)", "st.markdown(x, unsafe_allow_html=True)", "u = 'https://api.together.xyz/v1'", "print(system_prompt)", "auto_approve = True", "q = \"x' OR 1=1\"", "app.run(debug=True)",
    "subprocess.run(response)", "def __reduce__(self): pass", "k = process.env.OPENAI_API_KEY", "import A from '@anthropic-ai/sdk'", "t = Tool(name='x')  # agent", "model: gpt-4o", "resource \"aws_sagemaker_model\" \"m\" {}", "requests.get(url); tool = 1",
)
#: Rules that every engine's patterns can express, wherever their path lies.
PLAIN = tuple(r for g in catalogue.GROUPS.values() for r in g if "(?!" not in r.pattern and not r.path)
_LINE = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in CODE_LINES) + "]"


@query(f"""with coded as (select repo, path, content || chr(10) || {_LINE}[doc_id % {len(CODE_LINES)} + 1] || chr(10) || {_LINE}[doc_id // {len(CODE_LINES)} % {len(CODE_LINES)} + 1] as content from files)
select {', '.join(_FOUND)} from ({_rules_sql(PLAIN, "coded")})""", "files")
def catalogue_findings(c):
    """The wider catalogue over all files, each with two lines of code at its end."""
    line = lambda n: F.element_at(F.array(*[F.lit(x) for x in CODE_LINES]), (n % len(CODE_LINES) + 1).cast("int"))
    coded = F.concat_ws("\n", "content", line(F.col("doc_id")), line(F.floor(F.col("doc_id") / len(CODE_LINES))))
    return rules.detect(c.files().withColumn("content", coded), PLAIN).select(*_FOUND)


_EMAIL = "[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]+"
#: Positions by splitting, in DuckDB: running sums over gaps and matches.
_OFFSETS = f"""m as (select repo, path, unnest(regexp_extract_all(content, '{_EMAIL}')) as match, unnest(string_split_regex(content, '{_EMAIL}')[1:len(regexp_extract_all(content, '{_EMAIL}'))]) as gap,
  generate_subscripts(regexp_extract_all(content, '{_EMAIL}'), 1) as n from files where regexp_matches(content, '{_EMAIL}'))"""


@query(f"""with {_OFFSETS} select repo, path, match, (sum(length(gap) + length(match)) over w - length(match))::int as start, (sum(length(gap) - length(replace(gap, chr(10), ''))) over w + 1)::int as line
from m window w as (partition by repo, path order by n)""", "files")
def regex_match_offsets(c):
    return tx.matches(c.files(), ["repo", "path"], "content", _EMAIL)


@query("select doc_id, round(case when length(text) > 0 then entropy_of else 0 end, 9) as bits from (select doc_id, text, list_entropy(string_split(text, '')) as entropy_of from documents)")
def text_entropy(c):
    return c.table("documents").select("doc_id", F.round(tx.entropy(F.col("text")), 9).alias("bits"))


@query("select doc_id, (length(text) - length(replace(text, chr(10), '')) + 1)::int as lines, length(text)::int as chars from documents")
def line_counts(c):
    return c.table("documents").select("doc_id", F.size(tx.lines(F.col("text"))).alias("lines"), F.length("text").alias("chars"))


@query("""select repo, path, case when path like 'tests/%' then 'test' when path like 'docs/%' or path like '%.md' then 'docs' else 'production' end as context from files""", "files")
def path_context(c):
    return c.files().select("repo", "path", tx.path_class(F.col("path")).alias("context"))


@query("select md5(text) as content, min(doc_id) as doc_id, count(*)::bigint as copies from documents group by md5(text)")
def duplicate_texts(c):
    return c.table("documents").groupBy(F.md5("text").alias("content")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


_URL = "case when regexp_matches(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://') then"


@query("""select host, case when host like '%.net' then 'internal' else 'external' end as boundary, count(*)::bigint as pages from (select lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)', 1)) as host from pages) group by all""")
def hosts_and_boundaries(c):
    got = c.table("pages").select(web.host(F.col("url")).alias("host"))
    return got.groupBy("host", web.boundary(F.col("host"), (".net",)).alias("boundary")).agg(F.count(F.lit(1)).alias("pages"))


@query("select page_id, regexp_replace(regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+', '/', 'g'), '/$', '') as route from pages")
def routes_normalised(c):
    return c.table("pages").select("page_id", web.route(F.col("url")).alias("route"))


@query("select page_id, url from pages where regexp_matches(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/de/|/beta')")
def deprecated_routes(c):
    return c.table("pages").filter(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1).rlike("/de/|/beta")).select("page_id", "url")


@query("select repo, bool_or(regexp_matches(content, '[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+')) as has_email, bool_or(regexp_matches(content, '[0-9]{16}')) as has_card, bool_or(contains(lower(content), 'license')) as has_license from files group by repo", "files")
def repo_facts(c):
    return web.facts(c.files(), {"has_email": r"[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+", "has_card": "[0-9]{16}", "has_license": "(?i)license"})


@query("""with e as (select user_id, event_id, ts, (floor(epoch(ts))::bigint % 86400)::bigint as second_of_day from events where event_id % 7 <> 3 union all select user_id, event_id, ts, null from events where event_id % 7 = 3),
k as (select *, last_value(second_of_day ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as known, last_value(second_of_day ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and current row) as at_s from e),
r as (select *, sum(case when second_of_day < known then 86400 else 0 end) over (partition by user_id order by event_id rows between unbounded preceding and current row) as days from k)
select user_id, event_id, (coalesce(at_s, 0) + days)::bigint as ts from r""")
def log_clock_rollover(c):
    second = F.when(F.col("event_id") % 7 != 3, F.unix_seconds(F.col("ts").cast("timestamp")) % 86400)
    rows = c.table("events").select("user_id", "event_id", second.alias("second_of_day"))
    return logs.clock(rows, "user_id", "event_id", "second_of_day").select("user_id", "event_id", "ts")


@query("""select event_id, user_id, (coalesce(lead(floor(epoch(ts))::bigint) over (partition by user_id order by ts, event_id), max(floor(epoch(ts))::bigint) over (partition by user_id)) - floor(epoch(ts))::bigint)::bigint as duration from events""")
def batch_durations(c):
    rows = c.table("events").select("event_id", "user_id", "ts", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    ends = rows.groupBy("user_id").agg(F.max("s").alias("end"))
    return logs.durations(rows.join(ends, "user_id"), "user_id", ["ts", "event_id"], "s", "end").select("event_id", "user_id", "duration")


@query("select user_id, min(ts) filter (event_type = 'click') as clicked, min(ts) filter (event_type = 'view') as viewed, min(ts) filter (event_type = 'purchase') as bought from events group by user_id")
def phase_bounds(c):
    return logs.phases(c.table("events"), "user_id", {"clicked": "click", "viewed": "view", "bought": "purchase"}, "event_type", "ts")


@query("select event_type, date_trunc('day', ts)::timestamp as day, count(*)::bigint as n, round(sum(value), 4) as total from events group by all")
def events_daily(c):
    return c.table("events").groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("select conv_id, count(*)::bigint as turns, count(*) filter (role = 'user')::bigint as user_turns, max(turn) as last_turn, arg_min(role, turn) as first_role from conversations group by conv_id")
def conversation_shape(c):
    return c.table("conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.count_if(F.col("role") == "user").alias("user_turns"), F.max("turn").alias("last_turn"), F.min_by("role", "turn").alias("first_role"))


@query("select d.doc_id, l.quality, l.toxic, length(d.text)::int as chars from documents d left join labels l using (doc_id)")
def label_outer_join(c):
    return c.table("documents").join(c.table("labels"), "doc_id", "left").select("doc_id", "quality", "toxic", F.length("text").alias("chars"))
