"""Report operators and governance on small tables."""

from pyspark.sql import functions as F

from ashlar.functions import labels
from ashlar.operators import facts, governance, reports


def test_remediation_groups(spark):
    rows = [("r1", 2, "b", "x.py", 9, " "), ("r1", 1, "a", "y.py", 3, None), ("r1", 2, "a", "x.py", 1, "late"), ("r1", 2, "a", "x.py", 1, "late"), ("r1", 1, "c", "z.py", 1, "first"), ("r2", 3, "a", "x.py", 1, "no")]
    df = spark.createDataFrame(rows, "rule string, severity int, repo string, path string, line int, remediation string")
    got = reports.remediation_groups(df, places=2).collect()
    assert [tuple(r) for r in got] == [("r1", 1, 5, "first", 4, ["a/x.py:1", "a/y.py:3"])]
    assert reports.remediation_groups(df.limit(0)).count() == 0


def test_filters_orders_owners_and_registry(spark):
    df = spark.createDataFrame([("a", "x.py", 1, 2, "docs", "Key", " me "), ("b", "y.py", 2, 1, "odd", "key", None), ("a", "z.py", 3, 1, "production", "other", "")], "repo string, path string, line int, severity int, context string, rule string, owner string")
    assert [r["path"] for r in reports.report_filter(df, " KEY ", None, context="").orderBy(*reports.report_order()).collect()] == ["y.py", "x.py"]
    assert [r["path"] for r in df.orderBy(*reports.report_order()).collect()] == ["z.py", "y.py", "x.py"]
    assert reports.at_least(df, 1).count() == 2 and reports.at_least(df, 4).count() == 3
    owners = spark.createDataFrame([("a", "team"), ("a", "other"), ("c", "none")], "repo string, owner string")
    assert sorted((r["path"], r["owner"]) for r in reports.with_owner(df, owners).collect()) == [("x.py", "me"), ("y.py", ""), ("z.py", "other")]
    assert [(r["rule"], r["n"]) for r in reports.commonest(df.withColumn("rule", F.lower("rule")), "rule", 1).collect()] == [("key", 2)]
    names = spark.createDataFrame([(2, "openai", "OpenAI"), (1, "open_ai", "OpenAI"), (3, "x", "X")], "n int, name string, label string")
    assert {tuple(r) for r in reports.registry(names, ["n"]).collect()} == {("OpenAI", "open_ai"), ("X", "x")}
    assert {r["path"] for r in reports.selected(df, spark.createDataFrame([("x.py",), ("x.py",)], "path string"), "path").collect()} == {"x.py"}


def test_governance_without_columns(spark):
    bare = governance.governed(spark.createDataFrame([("r",)], "repo string")).first()
    assert (bare["role"], bare["policy_violations"], bare["usage_tags"]) == ("service", [], [])
    rows = [("r", True, True, [], ["SECURITY.md"], None, True), ("q", False, None, ["gh"], [], ["t"], False)]
    df = spark.createDataFrame(rows, "repo string, has_api_surface boolean, has_iac boolean, ci_systems array<string>, missing_governance array<string>, consumed_topics array<string>, prompt_handling boolean")
    got = {r["repo"]: (r["role"], r["policy_violations"], r["usage_tags"]) for r in governance.governed(df).collect()}
    assert got["r"] == ("api", ["api_without_security_policy", "iac_without_ci", "ai_without_governance"], ["api", "iac", "missing_governance", "policy_violation", "prompt"])
    assert got["q"] == ("worker", [], ["ci"])


def test_module_markers_and_languages(spark):
    paths = ["src/data-loader/Load_All.py", "src/data-loader/x.py", "data_loader/utils.py", "api/v1/routes.ts", "README.md", "notes.txt", ".env", "a.swift", "b.rst"]
    df = spark.createDataFrame([("r", p) for p in paths], "repo string, path string")
    assert {(r["marker"], r["n"]) for r in facts.module_markers(df).collect()} == {("data-loader", 3), ("load-all", 1)}
    assert facts.languages(df, ["repo"]).first()["languages"] == ["Python", "TypeScript", "Swift", "Env", "Markdown", "reStructuredText"]


def test_labels(spark):
    df = spark.createDataFrame([(1, "HIGH"), (2, "Sev-9"), (3, ""), (4, None), (2, " Own ")], "s int, l string")
    assert [r[0] for r in df.select(labels.severity_label(F.col("s"), F.col("l"))).collect()] == ["High", "High", "Medium", "Low", "Own"]
    t = spark.createDataFrame([(" Reviewed ",), ("FIXED",), (None,), ("odd",)], "t string").select(labels.triage_status(F.col("t")).alias("t"))
    assert [tuple(r) for r in t.select("t", labels.status_label(F.col("t"))).collect()] == [("in_remediation", "In Remediation"), ("fixed", "Fixed"), ("", "Open"), ("odd", "Open")]
