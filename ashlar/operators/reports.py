"""What reports show of findings: filters, orders, owners, selections and groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .findings import rows_by_rank

#: Contexts from the most to the least pressing.
CONTEXTS = ("production", "test", "docs", "deleted_file")
SEARCHED = ("repo", "path", "rule", "category", "capability", "description", "snippet", "match", "context", "policy_status")


def at_least(df: DataFrame, severity: int) -> DataFrame:
    """Findings of this severity or worse (1 is the worst, 4 keeps all)."""
    return df.filter(F.col("severity") <= severity)


def report_filter(df: DataFrame, text: str = "", severity: int | None = None, searched: tuple[str, ...] = SEARCHED, **equal: str | None) -> DataFrame:
    """Findings that hold the text in any searched column, case ignored, and equal all values that are given."""
    if text.strip():
        words = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in searched if c in df.columns]))
        df = df.filter(F.contains(words, F.lit(text.strip().lower())))
    if severity:
        df = df.filter(F.col("severity") == severity)
    for name, value in equal.items():
        df = df.filter(F.col(name) == value) if value else df
    return df


def context_rank(context: Column) -> Column:
    """Place of a context in ``CONTEXTS``; others come last."""
    place = F.array_position(F.array(*[F.lit(c) for c in CONTEXTS]), context)
    return F.when(F.coalesce(place, F.lit(0)) > 0, place).otherwise(len(CONTEXTS) + 1)


def report_order() -> list[Column]:
    return [F.col("severity"), context_rank(F.col("context")), F.col("repo"), F.col("path"), F.col("line")]


def commonest(df: DataFrame, value: str, most: int, by: tuple[str, ...] = ()) -> DataFrame:
    """``by``, value, n: the ``most`` commonest values (of each group), ties by name."""
    n = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return rows_by_rank(n, list(by), [F.desc("n"), value], most) if by else n.orderBy(F.desc("n"), value).limit(most)


def with_owner(findings: DataFrame, owners: DataFrame) -> DataFrame:
    """``findings`` with the owner that they name, else their repository's in ``owners`` (repo, owner), else empty."""
    mine = F.nullif(F.trim("owner"), F.lit("")) if "owner" in findings.columns else F.lit(None).cast("string")
    rows = findings.withColumn("__mine", mine).drop("owner")
    theirs = owners.groupBy("repo").agg(F.min(F.nullif(F.trim("owner"), F.lit(""))).alias("__theirs"))
    return rows.join(theirs, "repo", "left").withColumn("owner", F.coalesce("__mine", "__theirs", F.lit(""))).drop("__mine", "__theirs")


def selected(findings: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The findings whose ids were chosen, once each row."""
    return findings.join(ids.select(key).distinct(), key, "left_semi")


def remediation_groups(findings: DataFrame, worst: int = 2, places: int = 8) -> DataFrame:
    """rule, severity, n, text, places, shown: findings of severity ``worst`` or worse by rule.

    The worst severity, how many, the first remediation text that is not empty (by severity,
    repo, path and line), how many places (repo, path, line) and the first of them. Places are
    made distinct before they meet, and ``places`` of a rule are collected.
    """
    rows = findings.filter(F.col("severity") <= worst)
    rank = F.struct("severity", "repo", "path", "line")
    filled = F.trim(F.coalesce("remediation", F.lit(""))) != ""
    groups = rows.groupBy("rule").agg(F.min("severity").alias("severity"), F.count(F.lit(1)).alias("n"), F.min_by("remediation", F.when(filled, rank)).alias("text"))
    every = rows.select("rule", "repo", "path", "line").distinct()
    first = rows_by_rank(every, ["rule"], ["repo", "path", "line"], places)
    shown = F.array_sort(F.collect_list(F.struct("repo", "path", "line")))
    told = first.groupBy("rule").agg(F.transform(shown, lambda p: F.concat(p["repo"], F.lit("/"), p["path"], F.lit(":"), p["line"].cast("string"))).alias("shown"))
    return groups.join(every.groupBy("rule").agg(F.count(F.lit(1)).alias("places")), "rule").join(told, "rule")


def registry(names: DataFrame, order: list[str]) -> DataFrame:
    """name, label, first: approved libraries by their shown name, the first of each label in ``order``."""
    return names.groupBy("label").agg(F.min_by("name", F.struct(*order)).alias("name"))


def inventory_rows(profiles: DataFrame, columns: list[str]) -> DataFrame:
    """The columns in order as text for an export: lists joined by commas, booleans as yes and no, nulls empty."""
    types = dict(profiles.dtypes)

    def told(c: str) -> Column:
        kind = types.get(c, "")
        if not kind:
            return F.lit("")
        value = F.array_join(c, ", ") if kind.startswith("array") else F.when(F.col(c), "yes").otherwise("no") if kind == "boolean" else F.col(c).cast("string")
        return F.coalesce(value, F.lit(""))

    return profiles.select(*[told(c).alias(c) for c in columns])
