"""Queries over couplings in code and overlaps of repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import coupling as op
from ..operators import overlap
from .bindings import Corpus, registry

QUERIES, ORACLES, query = registry()

INTERNAL = (".example.net", ".example.org")


def code(c: Corpus) -> DataFrame:
    """Files that call the pages' URLs and name topics; five pages a repository."""
    p, q = F.col("page_id"), F.lit('"')
    repo = F.concat(F.lit("svc_"), F.floor(p / 5).cast("string"))
    topic = F.concat(F.lit("topic-"), (p % 97).cast("string"))
    call = F.when(p % 4 == 0, F.concat(F.lit("bus.publish("), q, topic, q)).when(p % 4 == 1, F.concat(F.lit("Subscribe( "), q, topic, q)).when(p % 4 == 2, F.concat(F.lit("listen "), q, topic, q)).otherwise(F.concat(F.lit("x.send("), q, topic, q))
    serves = F.when(p % 5 == 0, F.concat(F.lit("\nroute("), q, F.regexp_replace("url", r"/[^/]*$", ""), q, F.lit(")"))).otherwise(F.lit(""))
    return c.table("pages").select(repo.alias("repo"), F.concat(F.lit("fetch("), q, "url", q, F.lit(")\n"), call, F.lit(")"), serves).alias("content"))


def owners(c: Corpus) -> DataFrame:
    n = F.floor(F.col("page_id") / 5)
    rows = c.table("pages").select(F.concat(F.lit("svc_"), n.cast("string")).alias("repo"), F.when(n % 11 == 0, F.lit(" ")).otherwise(F.concat(F.lit("team_"), (n % 7).cast("string"))).alias("owner"), (n % 3 == 0).alias("provides"))
    return rows.distinct()


def dependencies(c: Corpus) -> DataFrame:
    n = F.floor(F.col("page_id") / 5)
    return c.table("pages").select(F.concat(F.lit("svc_"), n.cast("string")).alias("repo"), F.concat(F.lit("svc_"), F.floor(F.col("page_id") / 7).cast("string")).alias("peer")).distinct()


def _ends(c: Corpus) -> DataFrame:
    files = code(c)
    return op.ties(op.api_usage(files, INTERNAL), op.topics(files), dependencies(c), owners(c))


_CODE = r"""code as (
  select 'svc_' || (page_id // 5) as repo, 'fetch("' || url || '")' || chr(10) || case page_id % 4 when 0 then 'bus.publish("topic-' when 1 then 'Subscribe( "topic-' when 2 then 'listen "topic-' else 'x.send("topic-' end || (page_id % 97) || '")'
    || case when page_id % 5 = 0 then chr(10) || 'route("' || regexp_replace(url, '/[^/]*$', '') || '")' else '' end as content from pages
), urls as (
  select distinct repo, unnest(regexp_extract_all(content, '(?i)https?://[A-Za-z0-9._:-]+(?:/[A-Za-z0-9._~:/?#\[\]@!$&''()*+,;=%-]*)?')) as url from code
), parsed as (
  select repo, lower(regexp_extract(url, '(?i)^https?://([^/?#]+)(.*)$', 1)) as host, regexp_replace(regexp_replace(regexp_extract(regexp_extract(url, '(?i)^https?://([^/?#]+)(.*)$', 2), '^([^?#]*)', 1), '/{2,}', '/', 'g'), '/$', '') as path from urls
), usage as (
  select distinct repo, host, case when path <> '' then host || path end as route, case when regexp_replace(host, ':\d+$', '') in ('localhost', '127.0.0.1') or host like '%.example.net' or host like '%.example.org' then 'internal' else 'external' end as boundary,
    path <> '' and regexp_matches(lower(path), '/deprecated|/legacy|/v1/|/beta') as deprecated from parsed
), topics as (
  select distinct repo, regexp_extract(call, '"([^"]*)"', 1) as topic, case when regexp_matches(call, '(?i)subscribe|listen') then 'consumed' else 'produced' end as role
  from (select repo, unnest(regexp_extract_all(content, '(?i)\b(?:publish|produce|send|emit|subscribe|consume|listen)\s*\(?\s*"[A-Za-z0-9._-]{2,120}"')) as call from code)
)"""
_TIES = f"""{_CODE}, owners as (
  select distinct 'svc_' || (page_id // 5) as repo, case when page_id // 5 % 11 = 0 then 'Unowned' else 'team_' || (page_id // 5 % 7) end as owner, page_id // 5 % 3 = 0 as provides from pages
), routes as (
  select distinct repo, route from usage where boundary = 'internal' and route is not null
), offered as (
  select r.* from routes r join owners o on o.repo = r.repo and o.provides
), met as (
  select u.route, arg_max(o.route, length(o.route)) as item from (select distinct route from routes) u join (select distinct route from offered) o on u.route = o.route or starts_with(u.route, o.route || '/') group by u.route
), ends as (
  select 'route' as kind, m.item, r.repo, 'from' as side from (select distinct m.item, r.repo from routes r join met m using (route)) r join (select distinct item from met) m using (item)
  union all select 'route', route, repo, 'to' from offered
  union all select distinct 'host', host, repo, 'from' from usage where boundary = 'internal'
  union all select distinct 'host', u.host, u.repo, 'to' from usage u join owners o on o.repo = u.repo and o.provides where boundary = 'internal'
  union all select 'topic', topic, repo, case role when 'consumed' then 'from' else 'to' end from topics
  union all select distinct 'dependency', 'svc_' || (page_id // 7), 'svc_' || (page_id // 5), 'from' from pages
  union all select 'dependency', repo, repo, 'to' from owners
), couplings as (
  select a.kind, a.item, a.repo, ao.owner, b.repo as peer, bo.owner as peer_owner from ends a join ends b on a.kind = b.kind and a.item = b.item and a.side = 'from' and b.side = 'to'
    join owners ao on ao.repo = a.repo join owners bo on bo.repo = b.repo where ao.owner <> bo.owner
)"""


@query(f"with {_CODE} select * from usage")
def api_usage_from_code(c):
    return op.api_usage(code(c), INTERNAL)


@query(f"with {_CODE} select * from topics")
def topics_from_code(c):
    return op.topics(code(c))


@query(f"with {_TIES} select * from couplings")
def couplings_from_code(c):
    return op.couplings(_ends(c))


@query(f"with {_TIES} select kind, case kind when 'topic' then peer_owner else owner end as source, case kind when 'topic' then owner else peer_owner end as target, count(*)::bigint as n from couplings group by all")
def team_flows_from_code(c):
    return op.team_flows(_ends(c))


@query(f"""with {_TIES}, pairs as (select distinct repo, owner, case kind when 'topic' then 'events' when 'dependency' then 'dependencies' else 'api' end as sort, item, peer from couplings)
select repo, owner, count(*) filter (sort = 'dependencies')::bigint as dependencies, count(*) filter (sort = 'api')::bigint as api, count(*) filter (sort = 'events')::bigint as events, count(distinct peer)::bigint as peers,
  least(count(*) filter (sort = 'dependencies'), 8)::bigint + least(count(*) filter (sort = 'api'), 8)::bigint + least(count(*) filter (sort = 'events'), 8)::bigint as coupling from pairs group by repo, owner""")
def hidden_coupling(c):
    return op.hidden_coupling(_ends(c))


def inventory(c: Corpus) -> DataFrame:
    """Tags of repositories, one a customer; of three customers two have the tags of the first but for their libraries."""
    k = F.floor(F.col("c_custkey") / 2)
    tag = lambda p, n: F.concat(F.lit(p), n.cast("string"))
    return c.table("customer").select(
        F.col("c_custkey").alias("repo"), F.array(tag("t", k % 29), tag("t", k % 23)).alias("technologies"), F.array(tag("r", k % 11)).alias("runtimes"),
        F.when(k % 4 != 0, F.array(tag("a", k % 13))).alias("api_types"), F.array(tag("e", k % 17)).alias("event_systems"),
        F.array(tag("l", k % 41), tag("l", F.floor(k / 3) % 43)).alias("internal_dependency_names"), F.array(tag("m", k * 7 % 101), tag("m", F.floor(k / 10)), tag("m", k % 53)).alias("module_markers"),
    )


_INVENTORY = """inventory as (
  select c_custkey as repo, list_sort(list_distinct(['t' || k % 29, 't' || k % 23])) as t, ['r' || k % 11] as r, case when k % 4 <> 0 then ['a' || k % 13] else [] end as a, ['e' || k % 17] as e,
    list_sort(list_distinct(['l' || k % 41, 'l' || k // 3 % 43])) as l, list_sort(list_distinct(['m' || k * 7 % 101, 'm' || k // 10, 'm' || k % 53])) as m from (select c_custkey, c_custkey // 2 as k from customer)
), shared as (
  select x.repo as a, y.repo as b, list_sort(list_intersect(x.t, y.t)) as t, list_intersect(x.r, y.r) as r, list_intersect(x.a, y.a) as p, list_intersect(x.e, y.e) as e, list_sort(list_intersect(x.l, y.l)) as l, list_sort(list_intersect(x.m, y.m)) as m
  from inventory x join inventory y on x.repo < y.repo
), scored as (
  select *, (least(len(t), 2) + len(r) + len(p) + len(e) + least(len(l), 2) + least(len(m), 2))::int as score from shared where least(len(t), 2) + len(r) + len(p) + len(e) + least(len(l), 2) + least(len(m), 2) >= 4
)"""


@query(f"""with {_INVENTORY} select score, len(m)::int as modules, count(*)::bigint as pairs from scored group by all""")
def overlap_scores(c):
    """How many pairs of repositories have each score and number of shared markers."""
    found = overlap.overlap_counts(overlap.classes(inventory(c)))
    return found.groupBy("score", "modules").agg(F.floor(F.sum(F.col("n") * F.col("peers")) / 2).cast("long").alias("pairs"))


@query(f"""with {_INVENTORY}, ends as (select a as repo, b as peer, score from scored union all select b, a, score from scored) select repo, max(score) as overlap_score, count(*)::bigint as peers from ends group by repo""")
def repo_overlap_risk(c):
    return overlap.repo_risk(inventory(c))


@query(f"""with {_INVENTORY} select module, count(*)::bigint as n from (select unnest(m[1:6]) as module from scored) group by module""")
def duplicate_modules(c):
    return overlap.module_counts(overlap.classes(inventory(c)))
