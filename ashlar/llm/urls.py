"""URL filters: fixed rules, then a path-template tree.

A URL that no rule decides is judged by its template. The segments of a path
are typed (digits become ``{n}``, long hexadecimal runs ``{h}``), and the distinct
paths of each host form a tree that is generalised level by level, from the host down. The
children of a node are grouped by the template above them, so what lies below a
variable segment is one node however many values the segment has. A node most of
whose children are seen once or twice is variable: its children become ``*``. Of
others those branches merge whose shares of bad labels do not differ: branches
of one share (to 1/256) are pooled, and in order of share each is tested against the
next (two-proportion z-test); a run without a difference becomes ``~`` with its number.
What is left is the template; it is rejected if the share of bad labels among all of
its URLs, smoothed by a prior, reaches ``REJECT``.

Labels have two sides. A URL decided by a rule carries the rule's verdict; of the
others one whose host or path has a word of ``BAD_WORDS`` counts as bad and one
without as good. So a word alone rejects nothing: a template goes with all its
URLs if most of them are bad, and stays with all if few are. Labels of the user's
own (url, bad) take the place of the words where they are given.

Pages are read for their URL alone, and after the first grouping the work is on
distinct typed paths. Segments below ``LEVELS`` are one last segment, by its hash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, table

#: verdict, host, start of path
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
BAD_WORDS = ("adult", "ads", "bets", "casino", "escort", "gambling", "malware", "phishing", "pills", "poker", "porn", "sex", "spam", "viagra", "warez", "xxx")
LEVELS = 8
VARIABLE_CHILDREN, VARIABLE_MEAN = 20, 3.0
SHARES, MERGE_Z = 256, 1.96
PRIOR, STRENGTH, REJECT = 0.05, 4.0, 0.5


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path: after the first ``://`` up to ``/ ? #`` or the end, then
    up to ``? #`` or the end. Both empty for null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    host = F.coalesce(lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def typed_path(path: Column) -> Column:
    """Typed segments, joined by ``/``; all below ``LEVELS`` are one, their MD5."""
    typed = F.regexp_replace(F.regexp_replace(F.lower(path), r"[0-9a-f]{16,}", "{h}"), r"[0-9]+", "{n}")
    segments = F.split(F.regexp_replace(typed, r"^/+", ""), "/")
    rest = F.array(F.md5(F.array_join(F.slice(segments, F.lit(LEVELS + 1), F.size(segments)), "/")))
    return F.array_join(F.when(F.size(segments) > LEVELS, F.concat(F.slice(segments, 1, LEVELS), rest)).otherwise(segments), "/")


def _general(kids: DataFrame) -> DataFrame:
    """host, prefix, seg, general: what each child of a node is called. ``kids`` has
    host, prefix, seg, cn, cl and cb: its URLs, labels and bad labels. A node's shares
    are ``SHARES`` and one at most, so the window's groups are bounded."""
    node = ["host", "prefix"]
    kids = kids.withColumn("share", F.when(F.col("cl") > 0, F.floor(F.col("cb") * SHARES / F.col("cl")).cast("int")))
    parents = kids.groupBy(*node).agg(((F.count(F.lit(1)) >= VARIABLE_CHILDREN) & (F.sum("cn") < F.count(F.lit(1)) * VARIABLE_MEAN)).alias("variable"))
    shares = kids.filter("share is not null").groupBy(*node, "share").agg(F.sum("cl").alias("l"), F.sum("cb").alias("b"), F.count(F.lit(1)).alias("members"))
    by_share = W.partitionBy(*node).orderBy("share")
    l0, b0 = F.lag("l").over(by_share), F.lag("b").over(by_share)
    pooled = (F.col("b") + b0) / (F.col("l") + l0)
    spread = F.sqrt(pooled * (1.0 - pooled) * (1.0 / F.col("l") + 1.0 / l0))
    differs = F.coalesce((F.abs(F.col("b") / F.col("l") - b0 / l0) > MERGE_Z * spread).cast("int"), F.lit(0))
    runs = shares.withColumn("differs", differs).withColumn("run", F.sum("differs").over(by_share.rowsBetween(W.unboundedPreceding, 0)))
    size = runs.groupBy(*node, "run").agg(F.sum("members").alias("size"))
    runs = runs.select(*node, "share", "run").join(size, [*node, "run"])
    named = kids.join(parents, node).join(runs, [*node, "share"], "left")
    general = F.when(F.col("variable"), F.lit("*")).when(F.col("size") > 1, F.concat(F.lit("~"), F.col("run").cast("string"))).otherwise(F.col("seg"))
    return named.select(*node, "seg", general.alias("general"))


def templates(paths: DataFrame) -> DataFrame:
    """host, typed, template, lab, bad of distinct typed paths (host, typed, n, lab, bad)."""
    columns = ["host", "typed", "lab", "bad"]
    rows = durable(paths.select(*columns, "n", F.split("typed", "/").alias("segs"), F.lit("").alias("prefix")), "paths")
    depth = rows.agg(F.max(F.size("segs")).alias("d")).first()["d"] or 0  # LEVELS and one at most
    ended = []
    for level in range(depth):
        live = rows.withColumn("seg", F.col("segs")[level])
        kids = live.groupBy("host", "prefix", "seg").agg(F.sum("n").alias("cn"), F.sum("lab").alias("cl"), F.sum("bad").alias("cb"))
        live = live.join(_general(kids), ["host", "prefix", "seg"])
        live = live.select(*columns, "n", "segs", F.concat("prefix", F.lit("/" if level else ""), "general").alias("prefix"))
        rows = durable(live, "template-level")
        ended.append(rows.filter(F.size("segs") == level + 1).select(*columns, F.col("prefix").alias("template")))
        rows = rows.filter(F.size("segs") > level + 1)
    return reduce(DataFrame.unionByName, ended) if ended else rows.select(*columns, F.col("prefix").alias("template"))


def template_verdicts(urls: DataFrame) -> DataFrame:
    """host, typed, rejected: the method's verdict for every distinct typed path.

    ``urls`` has host, typed and bad (0 or 1; null: no label).
    """
    paths = urls.groupBy("host", "typed").agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("lab"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    named = templates(paths)
    purity = (F.sum("bad") + PRIOR * STRENGTH) / (F.sum("lab") + STRENGTH)
    judged = named.groupBy("host", "template").agg((purity >= REJECT).alias("rejected"))
    return named.join(judged, ["host", "template"]).select("host", "typed", "rejected")


def judge(pages: DataFrame, rules=RULES, bad_words=BAD_WORDS, labels: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages`` (page_id, url).

    ``labels`` (url, bad: 0 or 1) replaces the bad words; a URL with both labels
    has none, and one without label counts only for the tree's shape. Null and
    malformed URLs have empty host and path and are judged by that template. Repeated
    rows are judged alike and each counts as a URL; an empty table gives no rows.
    """
    host, path = split_url(F.col("url"))
    urls = pages.select("page_id", "url").select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    if labels is None:
        own = F.coalesce(F.lower(F.concat("host", "path")).rlike(f"(^|[^a-z])({'|'.join(bad_words)})([^a-z]|$)").cast("int"), F.lit(0))
    else:
        agreed = labels.select("url", F.col("bad").cast("int").alias("own")).groupBy("url").agg(F.min("own").alias("own"), F.max("own").alias("most")).filter("own = most")
        urls, own = urls.join(agreed.select("url", "own"), "url", "left"), F.col("own")
    urls = urls.withColumns({"rule": rule, "by_rule": verdict, "typed": typed_path(F.col("path"))})
    urls = urls.withColumn("bad", F.when(F.col("by_rule").isNotNull(), (F.col("by_rule") == "block").cast("int")).otherwise(own))
    decided = urls.filter(F.col("by_rule").isNotNull()).select("page_id", "host", "path", "rule", F.col("by_rule").alias("verdict"))
    rest = urls.filter(F.col("by_rule").isNull()).join(template_verdicts(urls), ["host", "typed"], "left")
    judged = rest.select("page_id", "host", "path", "rule", F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow")).alias("verdict"))
    return decided.unionByName(judged)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def _level_sql(n: int) -> str:
    """CTEs that give the paths' templates down to level ``n`` from those of the level above."""
    return f"""live{n} as (
  select *, segs[{n}] as seg from paths{n - 1} where len(segs) >= {n}
), kids{n} as materialized (
  select host, prefix, seg, sum(n)::bigint as cn, sum(bad)::bigint as cb, (sum(bad) * {SHARES} // sum(n))::int as share from live{n} group by all
), shares{n} as (
  select host, prefix, share, sum(cn)::bigint as l, sum(cb)::bigint as b, count(*) as members from kids{n} group by all
), before{n} as (
  select *, lag(l) over w as l0, lag(b) over w as b0 from shares{n} window w as (partition by host, prefix order by share)
), runs{n} as (
  select host, prefix, share, members, sum(case when abs(b / l - b0 / l0) > {MERGE_Z}::double * sqrt((b + b0) / (l + l0) * (1.0::double - (b + b0) / (l + l0)) * (1.0::double / l + 1.0::double / l0)) then 1 else 0 end)
    over (partition by host, prefix order by share rows between unbounded preceding and current row)::bigint as run from before{n}
), general{n} as (
  select k.host, k.prefix, k.seg, case when p.kids >= {VARIABLE_CHILDREN} and p.pn < p.kids * {VARIABLE_MEAN}::double then '*' when z.size > 1 then '~' || r.run else k.seg end as general
  from kids{n} k join (select host, prefix, count(*) as kids, sum(cn) as pn from kids{n} group by all) p using (host, prefix) join runs{n} r using (host, prefix, share)
    join (select host, prefix, run, sum(members) as size from runs{n} group by all) z using (host, prefix, run)
), paths{n} as materialized (
  select l.host, l.typed, l.n, l.bad, l.segs, l.prefix || {"'/' || " if n > 1 else ""}g.general as prefix from live{n} l join general{n} g using (host, prefix, seg)
)"""


OP10_SQL = rf"""
with parts as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end as rest from pages
), urls as (
  select page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from parts
), ruled as (
  select *, case
      when (host = 'example.com' or host like '%.example.com') and path like '/de/%' then 'example.com/de/'
      when (host = 'example.net' or host like '%.example.net') and path like '/en/%' then 'example.net/en/'
      when (host = 'org' or host like '%.org') and path like '/fr/%' then 'org/fr/'
      when (host = 'net' or host like '%.net') and path like '/%' then 'net/' end as rule,
    regexp_matches(lower(host || path), '(^|[^a-z])({"|".join(BAD_WORDS)})([^a-z]|$)') as lexical,
    string_split(regexp_replace(regexp_replace(regexp_replace(lower(path), '[0-9a-f]{{16,}}', '{{h}}', 'g'), '[0-9]+', '{{n}}', 'g'), '^/+', ''), '/') as segs
  from urls
), labelled as (
  select *, array_to_string(segs[1:{LEVELS}] || case when len(segs) > {LEVELS} then [md5(array_to_string(segs[{LEVELS + 1}:], '/'))] else []::varchar[] end, '/') as typed,
    case rule when 'net/' then 'block' when 'example.com/de/' then 'block' when 'example.net/en/' then 'allow' when 'org/fr/' then 'allow' end as by_rule from ruled
), paths0 as materialized (
  select host, typed, count(*)::bigint as n, sum(case when coalesce(by_rule = 'block', lexical) then 1 else 0 end)::bigint as bad, string_split(typed, '/') as segs, '' as prefix from labelled group by host, typed
), {", ".join(_level_sql(n) for n in range(1, LEVELS + 2))}, named as (
  {" union all ".join(f"select host, typed, n, bad, prefix as template from paths{n} where len(segs) = {n}" for n in range(1, LEVELS + 2))}
), templates as (
  select host, template, (sum(bad) + {PRIOR * STRENGTH}::double) / (sum(n) + {STRENGTH}::double) >= {REJECT}::double as rejected from named group by host, template
)
select l.page_id, l.host, l.path, l.rule, coalesce(l.by_rule, case when t.rejected then 'block' else 'allow' end) as verdict
from labelled l left join named n on n.host = l.host and n.typed = l.typed left join templates t on t.host = n.host and t.template = n.template
"""
QUERIES = {"op10_url_filter": op10_url_filter}
ORACLES = {"op10_url_filter": OP10_SQL}
