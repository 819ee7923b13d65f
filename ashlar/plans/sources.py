"""Queries over sources and sinks: what they read back of the tables that they are given."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facts, rules, web
from ..sources import files as src
from ..sources import records, sinks, snapshots
from ..sources.shared import shared_dir
from ..streaming import sessions, streams
from .bindings import registry

QUERIES, ORACLES, query = registry()


@query("select o_orderkey as scan_id, epoch(o_orderdate)::bigint as updated_at, o_orderpriority as project, case when o_orderkey % 5 <> 0 then o_custkey end as n from orders where o_orderkey % 7 <> 0 and o_orderkey % 11 <> 0")
def scan_records_read(c):
    """Stored records of all scans; one in seven is broken and one in eleven a list."""
    k = F.col("o_orderkey")
    text = F.to_json(F.struct(F.col("o_orderpriority").alias("project"), F.when(k % 5 != 0, F.col("o_custkey")).alias("n")))
    payload = F.when(k % 7 == 0, F.substring(text, F.lit(1), F.length(text) - 1)).when(k % 11 == 0, F.concat(F.lit("["), text, F.lit("]"))).otherwise(text)
    rows = c.table("orders").select(k.alias("scan_id"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("updated_at"), payload.alias("payload"))
    return records.scan_records(rows, "project string, n long")


@query("select repo, path, length(content)::int as size, length(content) <= 2000 as told from files", "files")
def facts_file_names(c):
    """The names of all files; contents of those that facts are read from, up to 2,000 characters."""
    listed = c.files().withColumn("size", F.length("content"))
    return snapshots.facts_files(listed, 2000).select("repo", "path", "size", F.col("content").isNotNull().alias("told"))


@query("select 'h' || o_custkey as finding_id, max(o_orderkey)::varchar as seen, arg_max(o_orderpriority, o_orderkey) as note from orders where o_custkey % 13 <> 0 group by o_custkey")
def baseline_rows(c):
    """A baseline file written and read: trimmed, without rows that have no key, the last row of a key."""
    at = shared_dir(c.spark, "baseline")
    key = F.when(F.col("o_custkey") % 13 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" h"), F.col("o_custkey").cast("string"), F.lit(" ")))
    rows = c.table("orders").select(key.alias("finding_id"), F.col("o_orderkey").alias("seen"), F.col("o_orderpriority").alias("note"))
    rows.orderBy("seen").coalesce(1).write.option("header", "true").csv(at)
    return src.read_baseline(c.spark, at)


@query("select path, path like 'docs/%' and not contains(path, '7') or regexp_matches(path, '(?i)3\\.(js|yaml)$') as ignored from files", "files")
def ignored_paths(c):
    return rules.ignored(c.files().select("path"), ["# texts", "docs/", "!docs/*7*", "*3.JS", "**/*3.yaml"])


@query("""with l as (select distinct repo, case when path like '%.py' then 1 when path like '%.js' then 2 when path like '%.yaml' then 16 else 24 end as p, case when path like '%.py' then 'Python' when path like '%.js' then 'JavaScript' when path like '%.yaml' then 'YAML' else 'Markdown' end as l from files)
select repo, list(l order by p) as languages from l group by repo""", "files")
def languages_by_repo(c):
    return facts.languages(c.files(), ["repo"])


@query("""with v as (select c_custkey as repo, ['python', 'Node.js', 'JVM', 'go', '.net'][c_custkey % 5 + 1] as runtime, (c_custkey // 5 % 25)::int as major, (c_custkey // 3 % 23)::int as minor from customer)
select repo, runtime, case runtime when 'python' then major || '.' || minor when 'go' then major || '.' || minor when 'Node.js' then case when major < 18 then '<18' when major < 20 then '18.x' when major < 22 then '20.x' else major || '.x' end
  when 'JVM' then case when major <= 8 then '8' when major <= 11 then '11' when major <= 17 then '17' else major || '+' end else case when major < 6 then '<6' when major < 8 then '6-7' else major || '+' end end as version,
  case runtime when 'python' then major < 3 or major = 3 and minor < 10 when 'go' then major < 1 or major = 1 and minor < 21 when 'Node.js' then major < 18 when 'JVM' then major <= 11 else major < 6 end as outdated from v""")
def runtime_versions(c):
    k = F.col("c_custkey")
    runtime = F.element_at(F.array(*[F.lit(x) for x in ("python", "Node.js", "JVM", "go", ".net")]), (k % 5 + 1).cast("int"))
    version = F.concat_ws(".", (F.floor(k / 5) % 25).cast("string"), (F.floor(k / 3) % 23).cast("string"), F.lit("1"))
    rows = c.table("customer").select(k.alias("repo"), runtime.alias("runtime"), version.alias("v"))
    return rows.select("repo", "runtime", web.runtime_version(F.col("runtime"), F.col("v")).alias("version"), web.outdated(F.col("runtime"), F.col("v")).alias("outdated"))


@query("""select l_orderkey as scan, l_partkey as part, l_linenumber as line, case when l_orderkey % 3 = 0 then 'again' else 'first' end as run from lineitem where l_orderkey % 3 <> 0 or l_linenumber % 2 = 0""")
def log_lines_replaced(c):
    """Logs of scans; those of every third scan are written again, with fewer lines, in the place of the first."""
    at = shared_dir(c.spark, "logs")
    table = sessions.KeyedTable(c.spark, at, "scan long, part long, line int, run string", ["scan"], "line", buckets=16)
    rows = c.table("lineitem").select(F.col("l_orderkey").alias("scan"), F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("line"))
    table.replace(rows.withColumn("run", F.lit("first")), "scan", 0)
    again = rows.filter("scan % 3 = 0")
    table.remove(again.select("scan").distinct(), 1)
    table.replace(again.filter("line % 2 = 0").withColumn("run", F.lit("again")), "scan", 2)
    return table.read()


@query("select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type from events group by user_id")
def latest_events_stream(c):
    """The latest event of each user, kept by a stream over files of events."""
    at = shared_dir(c.spark, "latest")
    c.table("events").select("user_id", "event_id", "event_type").repartition(3, F.xxhash64("event_id")).write.parquet(f"{at}/in")
    stream = c.spark.readStream.schema("user_id long, event_id long, event_type string").option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    streams.keep_latest(stream, f"{at}/table", f"{at}/checkpoint", "user_id", "event_id", 8).awaitTermination()
    return streams.latest_table(c.spark, f"{at}/table", stream.schema, "user_id", "event_id", 8).read()


@query("select o_orderkey as id, o_orderpriority as text from orders")
def report_rows_read(c):
    """A report's rows written as CSV, with quotes, breaks and control characters, and read again."""
    at = shared_dir(c.spark, "report")
    rows = c.table("orders").select(F.col("o_orderkey").alias("id"), F.concat(F.col("o_orderpriority"), F.lit('\x07"a"\nb')).alias("text"))
    sinks.write_csv(rows, at, ["id", "text"])
    back = c.spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(at)
    return back.select(F.col("id").cast("long").alias("id"), F.regexp_replace("text", ' "a"\nb$', "").alias("text"))
