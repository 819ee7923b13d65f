"""Second review of findings by an injected model, in Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERDICTS = ("keep", "downgrade", "dismiss")
OBJECT = re.compile(r"\{[^{}]*\}")


def eligible(skip: tuple[str, ...] = (), below: int = 55) -> Column:
    return ~F.col("rule").isin(*skip) & ((F.col("confidence") < below) | F.col("context").isin("docs", "test")) if skip else (F.col("confidence") < below) | F.col("context").isin("docs", "test")


def salvage(text: str | None) -> list[dict]:
    """Objects of a JSON array in a model's answer: fences are dropped, and of a
    broken array the complete objects are kept."""
    text = re.sub(r"```[a-z]*", "", text or "").strip()
    try:
        got = json.loads(text[text.index("[") : text.rindex("]") + 1])
        return [x for x in got if isinstance(x, dict)]
    except ValueError:
        pass
    out = []
    for m in OBJECT.finditer(text):
        try:
            out.append(json.loads(m[0]))
        except ValueError:
            continue
    return out


def review(findings: DataFrame, ask: Callable[[list[dict]], str], batch: int = 3) -> DataFrame:
    """id, verdict, reason for each finding (id, rule, context, confidence,
    snippet): ``ask`` answers a batch with a JSON array; what it leaves out or
    garbles is kept."""

    def answered(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = p.to_dict("records")
            ids, verdicts, reasons = [], [], []
            for at in range(0, len(rows), batch):
                group = rows[at : at + batch]
                got = {str(x.get("id")): x for x in salvage(ask(group))}
                for r in group:
                    x = got.get(str(r["id"]), {})
                    ids.append(r["id"])
                    verdicts.append(x.get("verdict") if x.get("verdict") in VERDICTS else "keep")
                    reasons.append(str(x.get("reason", "")))
            yield pd.DataFrame({"id": ids, "verdict": verdicts, "reason": reasons})

    return findings.select("id", "rule", "context", "confidence", "snippet").mapInPandas(answered, "id string, verdict string, reason string")


def apply_verdicts(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Dismissed findings go, downgraded ones lose one level of severity."""
    out = findings.join(verdicts, "id", "left").withColumn("verdict", F.coalesce("verdict", F.lit("keep"))).filter("verdict <> 'dismiss'")
    return out.withColumn("severity", F.when(F.col("verdict") == "downgrade", F.least(F.col("severity") + 1, F.lit(4))).otherwise(F.col("severity")))
