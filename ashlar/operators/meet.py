"""Inner joins in which few keys are shared by very many rows of both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

SIDE = 2048


def meet(a: DataFrame, b: DataFrame, on: list[str], side: int = SIDE) -> DataFrame:
    """The rows of ``a.join(b, on)``, spread over tasks by the number of rows that come out.

    The rows of a key are cut to pieces of about ``side`` rows; every piece of one side meets every
    piece of the other once, so no task has a whole key, and inputs of few bytes that make
    very many rows are not put into one task. All rows come out.
    """
    a, b = written(a, "meet"), written(b, "meet")
    n = lambda df, name: df.groupBy(*on).agg(F.count(F.lit(1)).alias(name))
    sizes = written(n(a, "__na").join(n(b, "__nb"), on), "meet-sizes")
    made = sizes.agg(F.sum(F.col("__na").cast("double") * F.col("__nb")), F.sum(F.col("__na") + F.col("__nb")).cast("double")).first()
    tasks = 1 + int((made[0] or 0) / side**2 + (made[1] or 0) / 1e6)
    pieces = lambda c: F.ceil(F.col(c) / side).cast("int")

    def cut(df: DataFrame, own: str, other: str, i: str, j: str) -> DataFrame:
        rows = df.join(sizes, on).withColumn(i, F.pmod(F.xxhash64(*df.columns), pieces(own)).cast("int"))
        rows = rows.withColumn(j, F.explode(F.sequence(F.lit(0), pieces(other) - 1)))
        return rows.select(*df.columns, "__i", "__j").repartition(tasks, *on, "__i", "__j")

    return cut(a, "__na", "__nb", "__i", "__j").join(cut(b, "__nb", "__na", "__j", "__i"), [*on, "__i", "__j"]).drop("__i", "__j")
