"""Scan records as they were stored, in many shapes: entries a repository, and counters a rule.

Records are JSON documents whose fields came and went. They are read as variants: a
field that is missing, null, or of another type gives way to the next best one, and a
number that is zero does as well where the record says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import triage_status

_MAP = "map<string,variant>"
SEVERITIES = {"critical": "1", "high": "2", "medium": "3", "low": "4"}


def _text(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "string"), F.lit(""))


def _whole(v: Column) -> Column:
    """An integer from a variant number or text; 0 for what is none."""
    return F.coalesce(F.try_variant_get(v, "$", "double"), F.lit(0.0)).cast("long")


def _number(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "double"), F.lit(0.0)).cast("long")


def _or(value: Column, other: Column) -> Column:
    """``value``, or ``other`` where it is 0."""
    return F.when(value != 0, value).otherwise(other)


def read(records: DataFrame, text: str = "record") -> DataFrame:
    """``records`` with ``v``: the JSON of column ``text``; rows that are no JSON object go."""
    # a filter on the parsed column would be pushed below it, and each text made and parsed twice
    parsed = F.filter(F.array(F.try_parse_json(F.col(text))), lambda v: F.schema_of_variant(v).startswith("OBJECT"))
    return records.withColumn("v", F.explode(parsed))


def repo_names(v: Column) -> Column:
    """The record's repositories: repo_slugs where it has that field, else repos; else the last
    folder of local_repo_path; else Unknown. Names are trimmed, empty ones left out."""
    fields = F.try_variant_get(v, "$", _MAP)
    listed = F.when(F.map_contains_key(fields, F.lit("repo_slugs")), F.try_variant_get(v, "$.repo_slugs", "array<string>")).otherwise(F.try_variant_get(v, "$.repos", "array<string>"))
    names = F.filter(F.transform(F.coalesce(listed, F.array().cast("array<string>")), lambda n: F.trim(n)), lambda n: n != "")
    path = F.regexp_replace(F.trim(_text(v, "$.local_repo_path")), r"(?<=.)/+$", "")
    last = F.element_at(F.split(path, "/"), -1)
    return F.when(F.size(names) > 0, names).when(path != "", F.array(F.when(last != "", last).otherwise(path))).otherwise(F.array(F.lit("Unknown")))


def _findings(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$.findings", "array<variant>"), F.array().cast("array<variant>"))


def _told(v: Column) -> Column:
    """The repo and delta of each finding that a record holds."""
    return F.transform(_findings(v), lambda f: F.struct(F.trim(_text(f, "$.repo")).alias("repo"), F.lower(F.trim(_text(f, "$.delta_status"))).alias("delta")))


def repo_entries(records: DataFrame, key: list[str]) -> DataFrame:
    """key, repo, total, critical, high, medium, low, critical_prod, high_prod, new_count, fixed_count.

    One row a repository of each record. A record of one repository has its overall
    figures, where they are zero or missing those of its per_repo map, then counts of its
    findings; of several repositories each has its part of the map, new counts
    from the findings, and no fixed ones.
    """
    rows = records.select(*key, "v", repo_names(F.col("v")).alias("__names"), _told(F.col("v")).alias("__told"))
    # a record's findings are counted within it: nothing is shuffled
    rows = rows.select(*key, "v", "__told", F.size("__names").alias("__n"), F.explode("__names").alias("repo"))
    mine = lambda t: t["repo"] == F.col("repo")
    rows = rows.withColumns({"__found": F.size(F.filter("__told", mine)).cast("long"), "__new": F.size(F.filter("__told", lambda t: mine(t) & (t["delta"] == "new"))).cast("long")})
    v = F.col("v")
    fields = F.try_variant_get(v, "$", _MAP)
    mine = F.try_variant_get(v, "$.per_repo", _MAP)[F.col("repo")]
    part = F.try_variant_get(mine, "$", _MAP)
    rows = rows.withColumns({"__fields": fields, "__part": part, "__sev": F.try_variant_get(mine, "$.sev", _MAP), "__all": F.try_variant_get(v, "$.sev", _MAP), "__delta": F.try_variant_get(v, "$.delta", _MAP)})
    has = lambda c, name: F.coalesce(F.map_contains_key(c, F.lit(name)), F.lit(False))
    whole = lambda c, name: _whole(F.col(c)[name])
    one = F.col("__n") == 1
    count = F.when(has("__part", "count"), whole("__part", "count")).otherwise(F.col("__found"))
    given = F.when(has("__fields", "total"), whole("__fields", "total")).when(has("__fields", "active_total"), whole("__fields", "active_total")).otherwise(count)
    rows = rows.withColumn("total", F.when(one, _or(given, count)).otherwise(count))
    for name, level in SEVERITIES.items():
        rows = rows.withColumn(name, F.when(one, _or(whole("__all", name), whole("__sev", level))).otherwise(whole("__sev", level)))
    for name in ("critical", "high"):
        rows = rows.withColumn(f"{name}_prod", F.when(one, _or(whole("__fields", f"{name}_prod"), F.col(name))).otherwise(F.col(name)))
    new = F.when(one, _or(whole("__delta", "new_count"), F.col("__new"))).otherwise(F.col("__new"))
    fixed = F.when(one, whole("__delta", "fixed_count")).otherwise(F.lit(0).cast("long"))
    return rows.select(*key, "repo", "total", *SEVERITIES, "critical_prod", "high_prod", new.alias("new_count"), fixed.alias("fixed_count"))


def rule_counters(records: DataFrame, triage: DataFrame, key: list[str]) -> DataFrame:
    """rule, active, suppressed, noisy over all ``read`` records.

    A record's findings count with the status that triage (hash, status) has now, or else
    the one stored with them; a record without findings has the counters that it kept in
    trend.rules. noisy is the sum of both.
    """
    zero, none = F.lit(0).cast("long"), F.lit("")
    row = lambda rule, hash, stored, active, suppressed: F.struct(rule.alias("rule"), hash.alias("hash"), stored.alias("stored"), active.alias("active"), suppressed.alias("suppressed"))

    def counted(f: Column) -> Column:
        rule = F.coalesce(F.nullif(_text(f, "$.provider_or_lib"), none), F.nullif(_text(f, "$.category"), none), F.lit("unknown"))
        return row(rule, _text(f, "$._hash"), _text(f, "$.triage_status"), F.lit(None).cast("long"), F.lit(None).cast("long"))

    def kept(kind: str) -> Column:
        entries = F.coalesce(F.map_entries(F.try_variant_get("v", f"$.trend.rules.{kind}", _MAP)), F.array().cast("array<struct<key:string,value:variant>>"))
        n = lambda e: (_whole(e["value"]), zero) if kind == "active" else (zero, _whole(e["value"]))
        return F.transform(entries, lambda e: row(e["key"], F.lit(None).cast("string"), none, *n(e)))

    # one reading: findings or counters of a record leave it together, and equal ones meet triage as one
    each = F.transform(F.array(_findings(F.col("v"))), lambda fs: F.when(F.size(fs) > 0, F.transform(fs, counted)).otherwise(F.concat(kept("active"), kept("suppressed"))))[0]
    rows = records.select(F.explode(each).alias("r")).select("r.*").groupBy("rule", "hash", "stored").agg(F.count_if(F.col("active").isNull()).alias("n"), F.sum("active").alias("a"), F.sum("suppressed").alias("s"))
    live = triage.select("hash", F.col("status").alias("live"))
    gone = triage_status(F.coalesce(F.nullif("live", none), F.col("stored"))) == "false_positive"
    rows = rows.join(live, "hash", "left").select(
        "rule", (F.coalesce("a", zero) + F.when(gone, zero).otherwise(F.col("n"))).alias("active"), (F.coalesce("s", zero) + F.when(gone, F.col("n")).otherwise(zero)).alias("suppressed"),
    )
    got = rows.groupBy("rule").agg(F.sum("active").alias("active"), F.sum("suppressed").alias("suppressed"))
    return got.withColumn("noisy", F.col("active") + F.col("suppressed"))
