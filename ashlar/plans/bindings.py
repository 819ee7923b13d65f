"""Scans, findings, triage, files and events derived from the driver's tables.

Each view is built with the DataFrame API and, for the oracle, as one CTE.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CTE = {
    "scans": """scans as (
  select o_orderkey as scan_id, concat('repo_', cast(o_custkey % 50 as varchar(12))) as repo, concat('P', cast(o_custkey % 5 as varchar(12))) as project_key,
    o_orderdate as started_at, case o_orderstatus when 'F' then 'done' when 'O' then 'stopped' else 'error' end as state,
    concat('model_', cast(o_custkey % 4 as varchar(12))) as llm_model from orders)""",
    "findings": """findings as (
  select l.l_orderkey as scan_id, s.repo, s.project_key, s.started_at,
    md5(concat(s.repo, '::src/f', cast(l.l_partkey % 20 as varchar(12)), '.py::m', cast(l.l_partkey % 100 as varchar(12)))) as hash,
    concat('src/f', cast(l.l_partkey % 20 as varchar(12)), '.py') as file, l.l_linenumber as line, 1 + cast(l.l_partkey % 4 as int) as severity,
    concat('rule_', cast(l.l_suppkey % 12 as varchar(12))) as rule,
    case when l.l_suppkey % 12 < 6 then 'Security' when l.l_suppkey % 12 < 9 then 'External AI API' else 'RAG/Vector DB' end as category,
    case l.l_returnflag when 'R' then 'test' when 'N' then 'docs' else 'production' end as context,
    cast(l.l_quantity as int) + 40 as confidence, l.l_partkey % 100 as mk, l.l_partkey as part, l.l_suppkey as supp, l.l_extendedprice as price
  from lineitem l join scans s on l.l_orderkey = s.scan_id)""",
    "triage": """triage as (
  select distinct hash, case mk % 7 when 0 then 'false_positive' when 1 then 'accepted_risk' when 2 then 'sent_for_review' else 'reviewed' end as status
  from findings where mk % 7 < 4)""",
    "files": """files as (
  select source as repo, concat(case when doc_id % 10 = 0 then 'tests/' when doc_id % 10 = 1 then 'docs/' else 'src/' end, 'd', cast(doc_id as varchar(20)),
    case lang when 'en' then '.py' when 'fr' then '.js' when 'de' then '.md' else '.yaml' end) as path, doc_id, text as content from documents)""",
    "lists": """lists as (
  select * from (values ('rule_6', 'approved'), ('rule_7', 'restricted'), ('rule_8', 'banned'), ('rule_9', 'approved')) as v(rule, policy_list))""",
    "profiles": """profiles as (
  select concat('repo_', cast(c_custkey as varchar(12))) as repo, c_custkey as ord, n_name as owner, concat('P', cast(c_custkey % 5 as varchar(12))) as project_key,
    c_mktsegment as segment, case when c_custkey % 6 = 0 then 'ui' when c_custkey % 6 = 1 then 'api' when c_custkey % 6 = 2 then 'worker' when c_custkey % 6 = 3 then 'platform' else 'service' end as role,
    c_acctbal as balance from customer join nation on c_nationkey = n_nationkey)""",
    "edges": """edges as (
  select distinct concat('repo_', cast(l_partkey as varchar(12))) as src, concat('repo_', cast(l_orderkey * 2 // 15 as varchar(12))) as dst
  from lineitem where l_partkey <> l_orderkey * 2 // 15)""",
}
_NEEDS = {"findings": ("scans",), "triage": ("scans", "findings"), "scans": (), "files": (), "lists": (), "profiles": (), "edges": ()}


def oracle(sql: str, *names: str) -> str:
    """``sql`` with the CTEs of the named views, and those that they need."""
    order = []
    for n in names:
        for x in (*_NEEDS[n], n):
            if x not in order:
                order.append(x)
    body = sql.strip()
    more = body[5:] if body.lower().startswith("with ") else None
    head = "with " + ",\n".join(CTE[n] for n in order)
    return f"{head},\n{more}" if more else f"{head}\n{body}"


def registry() -> tuple[dict, dict, Callable]:
    """QUERIES, ORACLES and the decorator that enters a plan, with its SQL over views, in both."""
    queries, oracles = {}, {}

    def query(sql: str | None = None, *views: str):
        def keep(f):
            queries[f.__name__] = lambda spark, sf_dir: f(Corpus(spark, sf_dir))
            if sql:
                oracles[f.__name__] = oracle(sql, *views) if views else sql
            return f

        return keep

    return queries, oracles, query


class Corpus:
    """The views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def scans(self) -> DataFrame:
        o = self.table("orders")
        state = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "stopped").otherwise("error")
        mod = lambda p, n: F.concat(F.lit(p), (F.col("o_custkey") % n).cast("string"))
        return o.select(F.col("o_orderkey").alias("scan_id"), mod("repo_", 50).alias("repo"), mod("P", 5).alias("project_key"), F.col("o_orderdate").alias("started_at"), state.alias("state"), mod("model_", 4).alias("llm_model"))

    def findings(self) -> DataFrame:
        part, supp = F.col("l_partkey"), F.col("l_suppkey")
        text = lambda c: c.cast("string")
        category = F.when(supp % 12 < 6, "Security").when(supp % 12 < 9, "External AI API").otherwise("RAG/Vector DB")
        context = F.when(F.col("l_returnflag") == "R", "test").when(F.col("l_returnflag") == "N", "docs").otherwise("production")
        lines = self.table("lineitem").join(self.scans().select("scan_id", "repo", "project_key", "started_at"), F.col("l_orderkey") == F.col("scan_id"))
        return lines.select(
            "scan_id", "repo", "project_key", "started_at",
            F.md5(F.concat("repo", F.lit("::src/f"), text(part % 20), F.lit(".py::m"), text(part % 100))).alias("hash"),
            F.concat(F.lit("src/f"), text(part % 20), F.lit(".py")).alias("file"), F.col("l_linenumber").alias("line"), (1 + (part % 4).cast("int")).alias("severity"),
            F.concat(F.lit("rule_"), text(supp % 12)).alias("rule"), category.alias("category"), context.alias("context"),
            (F.col("l_quantity").cast("int") + 40).alias("confidence"), (part % 100).alias("mk"), part.alias("part"), supp.alias("supp"), F.col("l_extendedprice").alias("price"),
        )

    def triage(self) -> DataFrame:
        k = F.col("mk") % 7
        status = F.when(k == 0, "false_positive").when(k == 1, "accepted_risk").when(k == 2, "sent_for_review").otherwise("reviewed")
        return self.findings().filter(k < 4).select("hash", status.alias("status")).distinct()

    def files(self) -> DataFrame:
        d = F.col("doc_id")
        top = F.when(d % 10 == 0, "tests/").when(d % 10 == 1, "docs/").otherwise("src/")
        tail = F.when(F.col("lang") == "en", ".py").when(F.col("lang") == "fr", ".js").when(F.col("lang") == "de", ".md").otherwise(".yaml")
        return self.table("documents").select(F.col("source").alias("repo"), F.concat(top, F.lit("d"), d.cast("string"), tail).alias("path"), "doc_id", F.col("text").alias("content"))

    def lists(self) -> DataFrame:
        return self.spark.createDataFrame([("rule_6", "approved"), ("rule_7", "restricted"), ("rule_8", "banned"), ("rule_9", "approved")], "rule string, policy_list string")

    def profiles(self) -> DataFrame:
        k = F.col("c_custkey")
        role = F.when(k % 6 == 0, "ui").when(k % 6 == 1, "api").when(k % 6 == 2, "worker").when(k % 6 == 3, "platform").otherwise("service")
        rows = self.table("customer").join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        return rows.select(F.concat(F.lit("repo_"), k.cast("string")).alias("repo"), k.alias("ord"), F.col("n_name").alias("owner"), F.concat(F.lit("P"), (k % 5).cast("string")).alias("project_key"), F.col("c_mktsegment").alias("segment"), role.alias("role"), F.col("c_acctbal").alias("balance"))

    def edges(self) -> DataFrame:
        """A sparse graph that grows with the tables: about thirty edges a node, in both directions."""
        a, b = F.col("l_partkey"), F.expr("l_orderkey * 2 div 15")
        rows = self.table("lineitem").filter(a != b)
        name = lambda c: F.concat(F.lit("repo_"), c.cast("string"))
        return rows.select(name(a).alias("src"), name(b).alias("dst")).distinct()
