"""Log clocks, batch durations and phases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def clock(df: DataFrame, session: str, seq: str, second_of_day: str) -> DataFrame:
    """Adds ``ts``: seconds since the session's first midnight. A time of day that
    falls means a new day; lines without a time take the one before (0 if none)."""
    w = W.partitionBy(session).orderBy(seq)
    known = F.last(second_of_day, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    rolled = F.when(F.col(second_of_day) < known, 86400).otherwise(0)
    df = df.withColumn("__roll", rolled)
    days = F.sum("__roll").over(w.rowsBetween(W.unboundedPreceding, 0))
    at = F.last(second_of_day, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("ts", F.coalesce(at, F.lit(0)) + days).drop("__roll")


def parse(df: DataFrame, text: str) -> DataFrame:
    """Time of day and message of lines ``[HH:MM:SS] message``."""
    pattern = r"^\[(\d{2}):(\d{2}):(\d{2})\]\s?(.*)$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    number = lambda i: F.try_to_number(part(i), F.lit("99")).cast("int")
    hit = F.col(text).rlike(pattern)
    return df.withColumn("second_of_day", F.when(hit, number(1) * 3600 + number(2) * 60 + number(3))).withColumn("msg", F.when(hit, part(4)).otherwise(F.col(text)))


def durations(df: DataFrame, session: str, order: list[str], at: str, end: str) -> DataFrame:
    """Seconds from each batch to the next of its session, the last to ``end``."""
    w = W.partitionBy(session).orderBy(*order)
    return df.withColumn("duration", F.coalesce(F.lead(at).over(w), F.col(end)) - F.col(at))


def phases(df: DataFrame, session: str, markers: dict[str, str], kind: str, at: str) -> DataFrame:
    """First time of each marker in a session."""
    return df.groupBy(session).agg(*[F.min(F.when(F.col(kind) == k, F.col(at))).alias(name) for name, k in markers.items()])


def review_stats(df: DataFrame, session: str, msg: str) -> DataFrame:
    """Counts in review log lines: reviewed and skipped are sums over lines,
    dismissed and downgraded the last line's value and their sums."""
    number = lambda word: F.try_to_number(F.regexp_extract(msg, rf"{word}[=:]\s*(\d+)", 1), F.lit("999999999")).cast("long")
    rows = df.select(session, "seq", *[number(w).alias(w) for w in ("reviewed", "skipped", "dismissed", "downgraded")])
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return rows.groupBy(session).agg(F.sum("reviewed").alias("reviewed"), F.sum("skipped").alias("skipped"), last("dismissed"), last("downgraded"), F.sum("dismissed").alias("dismissed_sum"), F.sum("downgraded").alias("downgraded_sum"))


#: Phases in order: name, pattern of the line that starts it (the first one counts), phases of which the first that started ends it.
PHASES = (
    ("init", None, ("clone", "scan")),
    ("clone", r"branch:", ("scan", "llm review", "report")),
    ("scan", r"Starting (parallel )?scan", ("llm review", "report")),
    ("llm review", r"\[LLM\].*(Evaluating|Reviewing)|(Evaluating|Reviewing).*\[LLM\]", ("report",)),
    ("report", r"Generating reports", ()),
)
END = r"Scan (complete|stopped)\."


def phase_timeline(entries: DataFrame, states: DataFrame, session: str, seq: str = "seq", at: str = "ts", msg: str = "msg") -> DataFrame:
    """session, n, phase, seconds, state: the phases of each session and their total.

    A phase starts with the first line that its pattern finds, and ends with the first
    of its followers that started, else at the end: the last closing line, or the last line.
    Phases that did not start are pending, without seconds. What the phases leave
    of the whole goes to the last that started. ``states`` (session, state) may be
    ``running``, which marks that phase. One aggregate a session; no window.
    """
    rank = F.col(seq)
    first = lambda p: F.min_by(at, F.when(F.col(msg).rlike(p), rank))
    got = entries.groupBy(session).agg(
        F.min_by(at, rank).alias("init"), F.coalesce(F.max_by(at, F.when(F.col(msg).rlike(END), rank)), F.max_by(at, rank)).alias("__end"),
        *[first(p).alias(name) for name, p, _ in PHASES if p],
    ).join(states.select(session, F.lower(F.coalesce("state", F.lit(""))).alias("__state")), session, "left")

    def took(name: str, after: tuple) -> Column:
        # a phase that starts at time 0 ends none, as a zero is no time there
        end = F.coalesce(*[F.nullif(F.col(f"`{x}`"), F.lit(0)) for x in after], F.nullif("__end", F.lit(0)), F.col(f"`{name}`"))
        return F.greatest(end - F.col(f"`{name}`"), F.lit(0)).cast("long")

    names = [name for name, _, _ in PHASES]
    got = got.withColumns({f"__{name}": took(name, after) for name, _, after in PHASES})
    spent = sum((F.coalesce(F.col(f"`__{name}`"), F.lit(0)) for name in names[1:]), F.coalesce("__init", F.lit(0)))
    last = F.lit("init")
    for name in names[1:]:
        last = F.when(F.col(f"`{name}`").isNotNull(), name).otherwise(last)
    whole = F.greatest(F.col("__end") - F.col("init"), F.lit(0)).cast("long")
    got = got.withColumns({"__spent": spent, "__last": last, "__whole": whole})
    rest = F.greatest(F.col("__whole") - F.col("__spent"), F.lit(0))
    running = F.col("__state") == "running"

    def row(n: int, name: str) -> Column:
        mine, seconds = F.col("__last") == name, F.col(f"`__{name}`")
        state = F.when(F.col(f"`{name}`").isNull(), "pending").when(running & mine, "running").otherwise("done")
        return F.struct(F.lit(n).alias("n"), F.lit(name).alias("phase"), F.when(mine, seconds + rest).otherwise(seconds).alias("seconds"), state.alias("state"))

    total = F.when(F.col("__spent") + rest > 0, F.col("__spent") + rest).otherwise(F.col("__whole"))
    ended = F.when(running, "running").when(F.col("__state").isin("stopped", "error"), "stopped").otherwise("done")
    rows = F.array(*[row(i, n) for i, n in enumerate(names)], F.struct(F.lit(len(names)).alias("n"), F.lit("total").alias("phase"), total.alias("seconds"), ended.alias("state")))
    return got.select(session, F.explode(rows).alias("p")).select(session, "p.*")


REVIEWING = r"(?i)\[LLM\]\s+Reviewing\s+(\d+)\s+finding\(s\).*?\((\d+)\s+skipped"
BATCH = r"(?i)\[LLM\]\s+Batch\s+\d+/\d+"
DONE = r"(?i)\[LLM\]\s+Done.*?dismissed:(\d+).*?reinstated:(\d+).*?downgraded:(\d+)"


def review_summary(entries: DataFrame, session: str, seq: str = "seq", at: str = "ts", msg: str = "msg") -> DataFrame:
    """Figures of the model's review in each session's log.

    Elapsed seconds from the first reviewing line to the last of the model's lines; mean and
    last batch (each to the next one, the last to the end of the review); seconds a finding and
    findings a minute; failed batches; reviewed and skipped are sums, dismissed, reinstated
    and downgraded those of the last summary line. Sessions without review have nulls.
    """
    text, rank = F.col(msg), F.col(seq)
    number = lambda p, i: F.nullif(F.regexp_extract(text, p, i), F.lit("")).cast("long")
    model = text.contains("[LLM]")
    got = entries.groupBy(session).agg(
        F.min_by(at, F.when(model & text.rlike("Evaluating|Reviewing"), rank)).alias("started"), F.max_by(at, F.when(model, rank)).alias("ended"),
        F.coalesce(F.sum(number(REVIEWING, 1)), F.lit(0)).alias("reviewed"), F.coalesce(F.sum(number(REVIEWING, 2)), F.lit(0)).alias("skipped"),
        *[F.coalesce(F.max_by(number(DONE, i), F.when(text.rlike(DONE), rank)), F.lit(0)).alias(name) for i, name in ((1, "dismissed"), (2, "reinstated"), (3, "downgraded"))],
        F.count_if(text.contains("[LLM] Batch") & F.lower(text).contains("failed")).alias("failed_batches"),
    )
    batches = entries.filter(text.rlike(BATCH)).select(session, seq, at).join(got.select(session, "ended"), session)
    following = F.lead(at).over(W.partitionBy(session).orderBy(seq))
    batches = batches.withColumn("took", F.greatest(F.coalesce(following, F.col("ended")) - F.col(at), F.lit(0)))
    per = batches.groupBy(session).agg(F.count(F.lit(1)).alias("batches"), F.avg("took").alias("avg_batch"), F.max_by("took", seq).alias("last_batch"))
    elapsed = F.greatest(F.col("ended") - F.col("started"), F.lit(0))
    some = F.col("reviewed") > 0
    return (
        got.join(per, session, "left").withColumn("elapsed", elapsed)
        .withColumns({"avg_per_finding": F.when(some, F.col("elapsed") / F.col("reviewed")), "per_minute": F.when(some & (F.col("elapsed") > 0), F.col("reviewed") / F.col("elapsed") * 60.0)})
        .select(session, "elapsed", F.coalesce("batches", F.lit(0)).alias("batches"), "avg_batch", "last_batch", "avg_per_finding", "per_minute", "failed_batches", "reviewed", "skipped", "dismissed", "reinstated", "downgraded")
    )
