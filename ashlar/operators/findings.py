"""Relational operators on finding rows: dedupe, policy, triage, delta, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scoring


def first_wins(df: DataFrame, key: str | list[str], order: list) -> DataFrame:
    """The first row of each key in ``order``; rows whose key is null or empty stay all.

    Keyed rows are reduced by a map-side aggregate (``min_by`` over the whole
    row), so a key of many rows is no large window partition.
    """
    keys = [key] if isinstance(key, str) else key
    blank = F.lit(False)
    for k in keys:
        blank = blank | F.col(k).isNull() | (F.col(k).cast("string") == "")
    rank = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    kept = df.filter(~blank).groupBy(*keys).agg(F.min_by(F.struct(*df.columns), rank).alias("__row")).select("__row.*")
    return kept.unionByName(df.filter(blank).select(*df.columns))


def with_policy(df: DataFrame, lists: DataFrame, always: tuple[str, ...] = scoring.ALWAYS_CRITICAL) -> DataFrame:
    """Policy status and severity of findings; ``lists`` (rule, policy_list) is a
    policy table of a row a rule at most, which is broadcast: rules are few, and a shuffle
    by rule would hold each rule's findings in one task."""
    joined = df.join(F.broadcast(lists), "rule", "left")
    if "policy_status" not in df.columns:
        joined = joined.withColumn("policy_status", F.lit(None).cast("string"))
    status, severity = scoring.policy(always)
    return joined.select(*[c for c in joined.columns if c not in ("policy_status", "severity", "policy_list")], status.alias("policy_status"), severity.alias("severity"))


def annotate_triage(df: DataFrame, triage: DataFrame) -> DataFrame:
    return df.join(triage, "hash", "left")


def split_suppressed(df: DataFrame, suppressed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(active, suppressed) by hash."""
    return df.join(suppressed.select("hash"), "hash", "left_anti"), df.join(suppressed.select("hash"), "hash", "left_semi")


def upsert(old: DataFrame, new: DataFrame, key: str, at: str) -> DataFrame:
    """Last write wins; ``new`` wins ties."""
    both = old.withColumn("__n", F.lit(0)).unionByName(new.withColumn("__n", F.lit(1)))
    return both.groupBy(key).agg(F.max_by(F.struct(*[c for c in old.columns if c != key]), F.struct(at, "__n")).alias("__r")).select(key, "__r.*").select(*old.columns)


def delta(current: DataFrame, baseline: DataFrame, key: str = "hash") -> DataFrame:
    """key, change: new, unchanged or fixed."""
    a = current.select(key).distinct().withColumn("__c", F.lit(True))
    b = baseline.select(key).distinct().withColumn("__b", F.lit(True))
    both = a.join(b, key, "full_outer")
    return both.select(key, F.when(F.col("__b").isNull(), F.lit("new")).when(F.col("__c").isNull(), F.lit("fixed")).otherwise(F.lit("unchanged")).alias("change"))


def scoped_baseline(baseline: DataFrame, scanned: DataFrame, path: Column, scanned_path: Column) -> DataFrame:
    """Baseline rows of files that the scan covers."""
    paths = scanned.select(scanned_path.alias("__path")).distinct()
    return baseline.withColumn("__path", path).join(paths, "__path", "left_semi").drop("__path")


def corroborated(df: DataFrame, file_key: list[str], least: int = 3) -> DataFrame:
    """Distinct rules of each finding's file, and the confidence lifted where it
    has ``least`` or more. Aggregate and join: no window holds a whole file."""
    counts = df.groupBy(*file_key).agg(F.count_distinct("rule").alias("corroboration"))
    lifted = scoring.confidence({"corroborated": (F.col("corroboration") >= 3) & (F.col("corroboration") < 5), "well_corroborated": F.col("corroboration") >= 5})
    out = df.join(counts, file_key)
    return out.withColumn("confidence", F.when(F.col("corroboration") >= least, F.greatest("confidence", lifted)).otherwise(F.col("confidence")))


def summary(df: DataFrame) -> DataFrame:
    """kind, value, n: counts by category, severity, policy status and repo, and
    totals, in one pass over the findings."""
    pair = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))
    kinds = F.array(pair("category", F.col("category")), pair("severity", F.col("severity")), pair("policy", F.col("policy_status")), pair("repo", F.col("repo")), pair("total", F.lit("all")))
    return df.select(F.explode(kinds).alias("k")).groupBy("k.kind", "k.value").agg(F.count(F.lit(1)).alias("n"))


def secret_flow(df: DataFrame, secret: Column, usage: Column, key: list[str], per_kind: int = 2) -> DataFrame:
    """Files with both a secret and an AI use: evidence is the first rules of each
    kind by line; one synthetic finding a file."""
    flagged = df.withColumn("__s", secret).withColumn("__u", usage)
    files = flagged.groupBy(*key).agg(F.min("line").alias("line"), F.max((F.col("context") == "production").cast("int")).alias("prod"))
    places = flagged.select(*key, F.explode(F.array_compact(F.array(F.when(F.col("__s"), "s"), F.when(F.col("__u"), "u")))).alias("__k"), F.struct("line", "rule").alias("__p")).distinct()
    places = rows_by_rank(places, [*key, "__k"], ["__p"], per_kind)  # a file of many findings sends a few
    of = lambda k: F.array_sort(F.collect_list(F.when(F.col("__k") == k, F.col("__p")))).alias(k)
    got = files.join(places.groupBy(*key).agg(of("s"), of("u")), key).filter((F.size("s") > 0) & (F.size("u") > 0))
    names = lambda c: F.transform(F.slice(c, 1, per_kind), lambda x: x["rule"])
    return got.select(*key, "line", F.array_join(F.concat(names("s"), names("u")), ",").alias("evidence"), F.when(F.col("prod") == 1, 1).otherwise(2).alias("severity"), F.when(F.col("prod") == 1, 95).otherwise(88).alias("confidence"))


def within_lines(sources: DataFrame, sinks: DataFrame, key: list[str], before: int = 2, after: int = 12) -> DataFrame:
    """Band join: sources with a sink in the lines around, each once. Both sides
    are cut into bands of the window's width and joined on them, so that a file
    of many sinks does not meet all of its sources."""
    width = before + after + 1
    band = lambda c: F.floor(c / width)
    a = sources.withColumn("__band", F.explode(F.sequence(band(F.col("line") - before), band(F.col("line") + after))))
    b = sinks.select(*key, F.col("line").alias("__line"), band(F.col("line")).alias("__band")).distinct()
    hit = a.join(b, [*key, "__band"]).filter(F.col("__line").between(F.col("line") - before, F.col("line") + after))
    return hit.groupBy(*sources.columns).agg(F.count_distinct("__line").alias("n_sinks"))


def histogram(df: DataFrame, by: list[str], values: list, of: str) -> DataFrame:
    """Counts of the values of a column, one column each."""
    return df.groupBy(*by).agg(*[F.count_if(F.col(of) == v).alias(f"{of}_{v}") for v in values])


def executive_score(df: DataFrame) -> DataFrame:
    """Mean weighted severity of 0 to 100 and its band."""
    c = [F.count_if(F.col("severity") == i).alias(f"s{i}") for i in (1, 2, 3, 4)]
    got = df.agg(F.count(F.lit(1)).alias("n"), *c)
    raw = (F.col("s1") * 100 + F.col("s2") * 70 + F.col("s3") * 35 + F.col("s4") * 10) / F.col("n")
    score = F.when(F.col("n") > 0, F.floor(F.least(F.lit(100.0), raw))).otherwise(F.lit(0)).cast("int")
    return got.select("n", score.alias("score")).withColumn("band", F.when(F.col("score") >= 70, F.lit("high")).when(F.col("score") >= 35, F.lit("medium")).otherwise(F.lit("low")))


def page(df: DataFrame, order: list, number: int, size: int = 25) -> DataFrame:
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def first_values(df: DataFrame, by: list[str], value: str, most: int) -> DataFrame:
    """``by``, first, n: the first ``most`` distinct values of each group in order, and how
    many it has. Values are made distinct before groups meet, and few are collected."""
    values = df.select(*by, value).filter(F.col(value).isNotNull()).distinct()
    counts = values.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    first = rows_by_rank(values, by, [value], most).groupBy(*by).agg(F.array_sort(F.collect_list(value)).alias("first"))
    return first.join(counts, by).select(*by, "first", "n")


def rows_by_rank(df: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    """The first ``most`` rows of each group; Spark keeps a bounded heap a task."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("__n") <= most).drop("__n")
