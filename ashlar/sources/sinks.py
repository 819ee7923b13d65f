"""Report sinks: CSV, JSON lines, a JSON envelope, partitioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import printable


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """The columns in order; text is cleaned of control characters."""
    cols = [printable(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.select(*columns).dtypes]
    df.select(*cols).write.mode("overwrite").option("header", "true").option("escape", '"').option("quoteAll", "true").csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def envelope(df: DataFrame, meta: dict[str, str]) -> DataFrame:
    """One JSON text a finding under the report's meta data: rows of ``value`` that
    a text sink writes in parallel, a header line first by partition order."""
    return df.select(F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in meta.items()], F.struct(*df.columns).alias("finding"))).alias("value"))


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Writes the partitions that ``df`` holds and leaves all others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """SHA-256 of the rows, the same in any order: of the number of rows and of the sums
    of the four quarters of their hashes, which tasks add up before they meet."""
    row = F.sha2(F.to_json(F.struct(*columns)), 256)
    quarter = lambda i: F.conv(F.substring("h", 16 * i + 1, 16), 16, 10).cast("decimal(20,0)")
    sums = df.select(row.alias("h")).agg(F.count(F.lit(1)).cast("string").alias("n"), *[F.coalesce(F.sum(quarter(i)).cast("string"), F.lit("0")).alias(f"s{i}") for i in range(4)])
    return sums.select(F.sha2(F.concat_ws("|", "n", "s0", "s1", "s2", "s3"), 256).alias("fingerprint"))
