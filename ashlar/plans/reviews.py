"""Queries over findings reviewed twice. The reviewers are plain rules that stand for a model."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import two_pass
from ..sources.shared import shared_dir
from .bindings import Corpus, registry

QUERIES, ORACLES, query = registry()


def reviewer(batch: list[dict]) -> str:
    """Dismisses, downgrades, answers nonsense or leaves out by the number in the snippet."""
    out = []
    for r in batch:
        n = int(r["snippet"][1:])
        if n % 5 != 3:
            out.append({"id": r["id"], "verdict": {0: "Dismiss", 1: "downgrade", 2: "maybe"}.get(n % 5, "keep"), "reason": f"first {n}", "confidence": n * 2})
    return f"```json\n{json.dumps(out)}\n```"


def challenger(batch: list[dict]) -> str:
    """Takes back what was dismissed for an even reason."""
    n = int(batch[0]["first_reason"].split()[1])
    return json.dumps([{"verdict": "keep" if n % 10 == 0 else "dismiss", "reason": f"second {n}", "confidence": n}])


def asked(c: Corpus) -> DataFrame:
    return c.findings().select(
        "scan_id", "part", "supp", "price", "file", "line", "rule", "category", "context", "severity", "confidence",
        F.lit("Model call").alias("capability"), F.concat(F.lit("by "), "rule").alias("description"), F.concat(F.lit("m"), F.col("mk").cast("string")).alias("snippet"),
        F.col("rule").alias("match"), F.lit("REVIEW").alias("policy_status"), F.lit(0).alias("corroboration"),
    )


def _reviewed(c: Corpus) -> tuple[DataFrame, DataFrame]:
    rows = asked(c)
    return rows, two_pass.review_twice(rows, reviewer, challenger, shared_dir(c.spark, "ledger"), "rules", skip=("rule_11",), wait=0.0)


_REVIEW = """asked as (
  select *, rule <> 'rule_11' and (confidence < 55 or context in ('docs', 'test')) as eligible from findings
), judged as (
  select *, case when not eligible then null when mk % 5 = 0 and mk % 10 <> 0 then 'dismiss' when mk % 5 = 1 then 'downgrade' else 'keep' end as verdict,
    case when not eligible then null when mk % 10 = 0 then 'reinstated: second ' || mk when mk % 5 = 3 then 'no verdict returned' else 'first ' || mk end as reason,
    case when not eligible then null when mk % 5 = 0 then mk when mk % 5 = 3 then 0 else least(mk * 2, 100) end::int as review_confidence from asked
), kept as (
  select *, case when verdict = 'downgrade' then least(severity + 1, 4) else severity end as sev from judged where verdict is null or verdict <> 'dismiss'
)"""


@query(f"""with {_REVIEW}, scored as (select *, least(100, greatest(0, case context when 'production' then 85 when 'docs' then 15 else 30 end + case sev when 1 then 12 when 2 then 8 when 3 then 3 else 0 end)) as prod,
    least(100, 35 + 18 + 12 + 4 - case when context <> 'production' then 10 else 0 end) as evid, greatest(0, least(100, confidence)) as conf from kept)
select scan_id, line, part, supp, price, sev as severity, verdict, reason, eligible as reviewed, review_confidence, 'Sev-' || sev || ' (' || case sev when 1 then 'Critical' when 2 then 'High' when 3 then 'Medium' else 'Low' end || ')' as severity_label,
  least(100, case when review_confidence is null then round_even(conf * 0.4::double + prod * 0.35::double + evid * 0.25::double, 0)
    else round_even(round_even(conf * 0.4::double + prod * 0.35::double + evid * 0.25::double, 0) * 0.8::double + review_confidence * 0.2::double, 0) end::int) as overall from scored""", "findings")  # fmt: skip
def findings_reviewed_twice(c):
    got = two_pass.refreshed(_reviewed(c)[1])
    return got.select("scan_id", "line", "part", "supp", "price", "severity", "verdict", "reason", "reviewed", "review_confidence", "severity_label", "overall")


@query(f"""with {_REVIEW} select (select count(*) from findings)::bigint as findings, count(*)::bigint as kept, count(*) filter (eligible)::bigint as reviewed, count(*) filter (verdict = 'downgrade')::bigint as downgraded,
  count(*) filter (reason like 'reinstated%')::bigint as reinstated, count(*) filter (reason = 'no verdict returned')::bigint as unreviewed, (select count(*) from findings)::bigint - count(*)::bigint as dismissed from kept""", "findings")
def review_outcome(c):
    return two_pass.review_counts(*_reviewed(c))
