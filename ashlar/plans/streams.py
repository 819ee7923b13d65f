"""Queries over session logs: streams with state, the keyed table, phases and review figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import logs
from ..sources.shared import shared_dir
from ..streaming import clock, sessions
from .bindings import Corpus, registry

QUERIES, ORACLES, query = registry()


def lines(c: Corpus) -> DataFrame:
    """The events of each user as the log of a session; some lines have no time."""
    e = F.col("event_id")
    kind, n = F.col("event_type"), (e % 9).cast("string")
    msg = (
        F.when(kind == "click", F.concat(F.lit("branch: b"), n))
        .when((kind == "view") & (e % 3 == 0), F.concat(F.lit("[LLM] Reviewing "), n, F.lit(" finding(s) via m ("), (e % 4).cast("string"), F.lit(" skipped)")))
        .when(kind == "view", F.lit("Starting scan"))
        .when((kind == "error") & (e % 2 == 0), F.concat(F.lit("[LLM] Batch "), n, F.lit("/9 failed")))
        .when(kind == "error", F.concat(F.lit("[LLM] Batch "), n, F.lit("/9 (3 finding(s))...")))
        .when((kind == "purchase") & (e % 5 == 0), F.lit("Scan complete."))
        .when(kind == "purchase", F.concat(F.lit("[LLM] Done dismissed:"), n, F.lit(" reinstated:"), (e % 2).cast("string"), F.lit(" downgraded:"), (e % 3).cast("string")))
        .otherwise(F.lit("Generating reports"))
    )
    stamp = F.when(e % 7 != 3, F.concat(F.lit("["), F.date_format("ts", "HH:mm:ss"), F.lit("] "))).otherwise(F.lit(""))
    seq = F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).cast("long")
    return c.table("events").select(F.col("user_id").cast("string").alias("session"), seq.alias("seq"), F.concat(stamp, msg).alias("text"), "event_id")


_LINES = """lines as (
  select user_id::varchar as session, row_number() over (partition by user_id order by event_id)::bigint as seq, case when event_id % 7 <> 3 then (floor(epoch(ts))::bigint % 86400)::bigint end as second_of_day,
    case when event_type = 'click' then 'branch: b' || (event_id % 9) when event_type = 'view' and event_id % 3 = 0 then '[LLM] Reviewing ' || (event_id % 9) || ' finding(s) via m (' || (event_id % 4) || ' skipped)'
      when event_type = 'view' then 'Starting scan' when event_type = 'error' and event_id % 2 = 0 then '[LLM] Batch ' || (event_id % 9) || '/9 failed' when event_type = 'error' then '[LLM] Batch ' || (event_id % 9) || '/9 (3 finding(s))...'
      when event_type = 'purchase' and event_id % 5 = 0 then 'Scan complete.' when event_type = 'purchase' then '[LLM] Done dismissed:' || (event_id % 9) || ' reinstated:' || (event_id % 2) || ' downgraded:' || (event_id % 3) else 'Generating reports' end as msg from events
), known as (
  select *, last_value(second_of_day ignore nulls) over (partition by session order by seq rows between unbounded preceding and 1 preceding) as before,
    last_value(second_of_day ignore nulls) over (partition by session order by seq rows between unbounded preceding and current row) as now from lines
), entries as (
  select session, seq, msg, (coalesce(now, 0) + sum(case when second_of_day < before then 86400 else 0 end) over (partition by session order by seq rows between unbounded preceding and current row))::bigint as ts from known
)"""


@query(f"with {_LINES} select session, seq, msg, ts, msg = 'Scan complete.' as last from entries")
def log_clock_stream(c):
    """The log as a stream: a third of the lines is the backlog and comes again with the live ones, whose files are in no order."""
    spark, at = c.spark, shared_dir(c.spark, "log-stream")
    rows = lines(c).drop("event_id")
    rows.filter("seq % 3 = 0").write.parquet(f"{at}/backlog")
    rows.repartition(6, F.xxhash64("session", "seq")).write.parquet(f"{at}/live")
    stream = clock.clocked(clock.backlog_then_live(spark, f"{at}/backlog", f"{at}/live", 3))
    clock.send(stream, f"{at}/sent", f"{at}/checkpoint").awaitTermination()
    return spark.read.schema(clock.SENT).parquet(f"{at}/sent")


SESSION = "user_id long, event_id long, state string, events long, cents long, top double"


@query("""with d as (select user_id, max(event_id) filter (event_type = 'purchase' and event_id % 4 = 0) as dead from events group by user_id)
select e.user_id, max(event_id) as event_id, arg_max(event_type, event_id) as state, count(*)::bigint as events, sum(round(value * 100)::bigint)::bigint as cents, max(value) as top
from events e join d on e.user_id = d.user_id and (d.dead is null or e.event_id > d.dead) group by e.user_id""")
def session_table_stream(c):
    """Sessions as a keyed table under a stream of their events: the latest state, counters, and deletions by some purchases."""
    spark, at = c.spark, shared_dir(c.spark, "session-table")
    e = c.table("events")
    gone = (F.col("event_type") == "purchase") & (F.col("event_id") % 4 == 0)
    ups = e.select("user_id", "event_id", F.col("event_type").alias("state"), F.lit(1).cast("long").alias("events"), F.round(F.col("value") * 100).cast("long").alias("cents"), F.col("value").alias("top"), gone.alias("deleted"))
    table = sessions.KeyedTable(spark, f"{at}/table", SESSION, ["user_id"], "event_id", {"events": "sum", "cents": "sum", "top": "max"}, buckets=8)
    half = e.agg(F.max("event_id")).first()[0] // 2
    for part in (F.col("event_id") <= half, F.col("event_id") > half):  # the second run goes on from the checkpoint
        ups.filter(part).write.mode("append").parquet(f"{at}/updates")
        table.follow(spark.readStream.schema(SESSION + ", deleted boolean").parquet(f"{at}/updates"), f"{at}/checkpoint", "events").awaitTermination()
    return table.read()


def _entries(c: Corpus) -> DataFrame:
    return logs.clock(logs.parse(lines(c), "text"), "session", "seq", "second_of_day").select("session", "seq", F.col("ts").cast("long").alias("ts"), "msg")


def _states(c: Corpus) -> DataFrame:
    k = F.col("user_id") % 5
    return c.table("events").select(F.col("user_id").cast("string").alias("session"), F.when(k == 0, "running").when(k == 1, "stopped").otherwise("done").alias("state")).distinct()


@query(f"""with {_LINES}, marks as (
  select session, arg_min(ts, seq) as init, coalesce(arg_max(ts, seq) filter (msg = 'Scan complete.'), arg_max(ts, seq)) as done, arg_min(ts, seq) filter (msg like 'branch:%') as clone, arg_min(ts, seq) filter (msg = 'Starting scan') as scan,
    arg_min(ts, seq) filter (msg like '[LLM] Reviewing%') as review, arg_min(ts, seq) filter (msg = 'Generating reports') as report, case session::bigint % 5 when 0 then 'running' when 1 then 'stopped' else 'done' end as state from entries group by session
), z as (
  select *, nullif(clone, 0) as zc, nullif(scan, 0) as zs, nullif(review, 0) as zv, nullif(report, 0) as zr, nullif(done, 0) as ze from marks
), spans as (
  select session, state, 0 as n, 'init' as phase, init as s, coalesce(zc, zs, ze, init) as e, done, init from z union all select session, state, 1, 'clone', clone, coalesce(zs, zv, zr, ze, clone), done, init from z
  union all select session, state, 2, 'scan', scan, coalesce(zv, zr, ze, scan), done, init from z union all select session, state, 3, 'llm review', review, coalesce(zr, ze, review), done, init from z
  union all select session, state, 4, 'report', report, coalesce(ze, report), done, init from z
), took as (
  select *, greatest(e - s, 0)::bigint as seconds, n = max(case when s is not null then n end) over (partition by session) as mine, sum(coalesce(greatest(e - s, 0), 0)) over (partition by session) as spent, greatest(done - init, 0) as whole from spans
)
select session, n, phase, (case when mine then seconds + greatest(whole - spent, 0) else seconds end)::bigint as seconds, case when s is null then 'pending' when state = 'running' and mine then 'running' else 'done' end as state from took
union all select session, 5, 'total', case when max(spent) + greatest(max(whole) - max(spent), 0) > 0 then max(spent) + greatest(max(whole) - max(spent), 0) else max(whole) end::bigint, max(state) from took group by session""")
def phase_timeline(c):
    return logs.phase_timeline(_entries(c), _states(c), "session")


@query(f"""with {_LINES}, r as (
  select session, arg_min(ts, seq) filter (msg like '[LLM] Reviewing%') as started, arg_max(ts, seq) filter (msg like '[LLM]%') as ended, coalesce(sum(nullif(regexp_extract(msg, 'Reviewing ([0-9]+)', 1), '')::bigint), 0)::bigint as reviewed,
    coalesce(sum(nullif(regexp_extract(msg, '.([0-9]+) skipped', 1), '')::bigint), 0)::bigint as skipped, count(*) filter (msg like '%failed')::bigint as failed_batches,
    coalesce(arg_max(nullif(regexp_extract(msg, 'dismissed:([0-9]+)', 1), '')::bigint, seq) filter (msg like '[LLM] Done%'), 0) as dismissed,
    coalesce(arg_max(nullif(regexp_extract(msg, 'reinstated:([0-9]+)', 1), '')::bigint, seq) filter (msg like '[LLM] Done%'), 0) as reinstated,
    coalesce(arg_max(nullif(regexp_extract(msg, 'downgraded:([0-9]+)', 1), '')::bigint, seq) filter (msg like '[LLM] Done%'), 0) as downgraded from entries group by session
), b as (
  select e.session, seq, greatest(coalesce(lead(ts) over (partition by e.session order by seq), ended) - ts, 0) as took from entries e join r using (session) where msg like '[LLM] Batch%'
), p as (
  select session, count(*)::bigint as batches, sum(took)::double / count(*) as avg_batch, arg_max(took, seq)::bigint as last_batch from b group by session
)
select session, greatest(ended - started, 0)::bigint as elapsed, coalesce(batches, 0)::bigint as batches, avg_batch, last_batch, case when reviewed > 0 then greatest(ended - started, 0) / reviewed end as avg_per_finding,
  case when reviewed > 0 and greatest(ended - started, 0) > 0 then reviewed / greatest(ended - started, 0) * 60.0::double end as per_minute, failed_batches, reviewed, skipped, dismissed, reinstated, downgraded from r left join p using (session)""")
def review_log_summary(c):
    return logs.review_summary(_entries(c), "session")
