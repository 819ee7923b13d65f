"""Inventory helpers: overrides, coupling, tiers, previous rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def overridden(stored: DataFrame, live: DataFrame, key: str = "scan_id", running: str = "running", shown: str = "stopped") -> DataFrame:
    """Live rows replace stored ones of the same key; what still runs is shown as stopped."""
    rows = live.unionByName(stored.join(live.select(key), key, "left_anti").select(*live.columns))
    return rows.withColumn("state", F.when(F.col("state") == running, shown).otherwise(F.col("state")))


def coupling(producers: DataFrame, consumers: DataFrame, on: str, owners: DataFrame) -> DataFrame:
    """Producers and consumers of one thing that belong to different owners."""
    a = producers.join(owners, "repo").select(on, F.col("repo").alias("producer"), F.col("owner").alias("producer_owner"))
    b = consumers.join(owners, "repo").select(on, F.col("repo").alias("consumer"), F.col("owner").alias("consumer_owner"))
    return a.join(b, on).filter("producer_owner <> consumer_owner")


def tier(value: Column, steps: tuple[tuple[float, int], ...], rest: int) -> Column:
    """The first tier whose bound lies above the value."""
    out = F.lit(rest)
    for bound, result in reversed(steps):
        out = F.when(value < bound, result).otherwise(out)
    return out


def with_previous(df: DataFrame, session: str, order: str | list[str], value: str, first: str) -> DataFrame:
    """Adds ``before``: the value of the row before within the session."""
    return df.withColumn("before", F.coalesce(F.lag(value).over(W.partitionBy(session).orderBy(order)), F.lit(first)))


#: Families of model names (fixed values), and the usage flags that words imply.
MODELS = r"(?i)\b(?:gpt-[0-9][\w.-]*|o[134](?:-mini|-preview)?|claude-[\w.-]+|gemini-[\w.-]+|llama[-_ ]?[0-9][\w.-]*|mistral-[\w.-]+|mixtral-[\w.-]+|qwen[\w.-]*|phi-[0-9][\w.-]*|command-r[\w-]*|text-embedding-[\w-]+)\b"
FLAGS = {"prompts": r"(?i)prompt|completion|chat", "serving": r"(?i)serving|inference|vllm|triton|ollama", "agents": r"(?i)agent|tool|function.call", "vectors": r"(?i)embedding|vector|rag|faiss"}


def usage(findings: DataFrame) -> DataFrame:
    """One row a repository: counts, providers, categories, model names, flags."""
    text = F.concat_ws(" ", "match", "snippet", "capability")
    return findings.groupBy("repo").agg(
        F.count(F.lit(1)).alias("findings"), F.array_sort(F.collect_set("rule")).alias("providers"), F.array_sort(F.collect_set("category")).alias("categories"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.regexp_extract_all(text, F.lit(MODELS), F.lit(0)))))).alias("models"),
        *[F.bool_or(F.concat_ws(" ", "category", "capability", "rule").rlike(p)).alias(k) for k, p in FLAGS.items()],
    )
