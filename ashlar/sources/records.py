"""Stored scan records, logs and policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scan_records(rows: DataFrame, schema: StructType | str, payload: str = "payload") -> DataFrame:
    """Records of a job table (scan_id, updated_at, payload JSON); unreadable ones
    are dropped. Old field names are mapped to the present ones."""
    readable = F.schema_of_variant(F.try_parse_json(F.col(payload))).startswith("OBJECT")
    got = rows.filter(readable).withColumn("__r", F.from_json(F.col(payload), schema, {"mode": "PERMISSIVE"}))
    return got.select("scan_id", "updated_at", "__r.*")


def renamed(df: DataFrame, old: dict[str, str]) -> DataFrame:
    """Each new column takes the old one's value where it is null or missing."""
    for before, after in old.items():
        if before in df.columns:
            df = df.withColumn(after, F.coalesce(F.col(after), F.col(before)) if after in df.columns else F.col(before)).drop(before)
    return df


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """session (file), seq, text of log files."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("session"), F.posexplode(F.split("value", "\n")).alias("seq", "text"))
    return rows


def policy_lists(spark: SparkSession, policy: dict) -> DataFrame:
    """rule, policy_list of a policy document; banned wins over restricted over approved."""
    named = {}
    for kind in ("approved", "restricted", "banned"):
        named |= {p: kind for p in policy.get(f"{kind}_providers", ())}
    return spark.createDataFrame(list(named.items()), "rule string, policy_list string")
