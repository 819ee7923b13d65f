"""Threat model: threats of findings and of the architecture, and the data-flow diagram."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import short_id

#: STRIDE class, mitigation and the words of a finding that call for it; the first that fits. A parameter.
CLASSES = (
    ("Information disclosure", "Rotate the credential and keep it in a vault.", r"(?i)credential|key|token|secret"),
    ("Elevation of privilege", "Do not run text that a model or a user gives.", r"(?i)exec|eval|pickle|remote_code"),
    ("Tampering", "Check and bind what enters statements and prompts.", r"(?i)sql|prompt|injection|jailbreak"),
    ("Repudiation", "Keep prompts and answers out of plain logs.", r"(?i)log|debug"),
    ("Spoofing", "Authenticate the endpoint and pin its host.", r"(?i)api|http|endpoint|gateway|proxy"),
)
OTHER = ("Denial of service", "Bound size, rate and time of model calls.")


def stride(words: Column, classes=CLASSES) -> tuple[Column, Column]:
    kind, cure = F.lit(OTHER[0]), F.lit(OTHER[1])
    for name, mitigation, pattern in reversed(classes):
        kind, cure = F.when(words.rlike(pattern), F.lit(name)).otherwise(kind), F.when(words.rlike(pattern), F.lit(mitigation)).otherwise(cure)
    return kind, cure


def finding_threats(findings: DataFrame, classes=CLASSES) -> DataFrame:
    """id, repo, file, rule, stride, mitigation, severity: one threat for each rule
    in each file (repo, file, rule, category, severity), the worst severity."""
    kind, cure = stride(F.concat_ws(" ", "rule", "category"), classes)
    rows = findings.groupBy("repo", "file", "rule", "category").agg(F.min("severity").alias("severity"))
    return rows.select(short_id("threat", F.col("repo"), F.col("file"), F.col("rule")).alias("id"), "repo", "file", "rule", kind.alias("stride"), cure.alias("mitigation"), "severity")


#: Summaries of a repository: name, STRIDE class, and the test over its findings.
SUMMARIES = (
    ("Secrets in code", "Information disclosure", "count_if(category = 'Security') > 0"),
    ("Calls to hosted models", "Spoofing", "count_if(category like 'External%') > 0"),
    ("Retrieved text reaches a model", "Tampering", "count_if(category like 'RAG%') > 0"),
    ("Many findings in production", "Elevation of privilege", "count_if(context = 'production') > 10"),
    ("Secrets beside hosted models", "Information disclosure", "count_if(category = 'Security') > 0 and count_if(category like 'External%') > 0"),
    ("Critical findings", "Elevation of privilege", "count_if(severity = 1) > 0"),
)


def architecture_threats(findings: DataFrame, summaries=SUMMARIES) -> DataFrame:
    """repo, title, stride: the summaries that hold for each repository."""
    held = findings.groupBy("repo").agg(*[F.expr(test).alias(f"s{i}") for i, (_, _, test) in enumerate(summaries)])
    given = F.array_compact(F.array(*[F.when(F.col(f"s{i}"), F.struct(F.lit(t).alias("title"), F.lit(k).alias("stride"))) for i, (t, k, _) in enumerate(summaries)]))
    return held.select("repo", F.explode(given).alias("s")).select("repo", "s.title", "s.stride")


def diagram(findings: DataFrame) -> DataFrame:
    """repo, diagram: the data-flow diagram of each repository as JSON: the user, the
    repository's process, a store where vectors are used, the hosted models, the
    flows between them and the trust boundary around process and store."""
    seen = findings.groupBy("repo").agg(F.bool_or(F.col("category").like("External%")).alias("hosted"), F.bool_or(F.col("category").like("RAG%")).alias("stored"), F.count(F.lit(1)).alias("threats"))
    cell = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))
    flow = lambda a, b: F.struct(a.alias("from"), b.alias("to"))
    repo, user, store, model = F.col("repo"), F.lit("User"), F.lit("Vector store"), F.lit("Hosted model")
    cells = F.array_compact(F.array(cell("actor", user), cell("process", repo), F.when(F.col("stored"), cell("store", store)), F.when(F.col("hosted"), cell("actor", model))))
    flows = F.array_compact(F.array(flow(user, repo), F.when(F.col("stored"), flow(repo, store)), F.when(F.col("hosted"), flow(repo, model))))
    inside = F.array_compact(F.array(repo, F.when(F.col("stored"), store)))
    return seen.select("repo", F.to_json(F.struct(cells.alias("cells"), flows.alias("flows"), inside.alias("boundary"), "threats")).alias("diagram"))
