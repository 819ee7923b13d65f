"""What the plans of queries may hold: shuffles by keys of few values, repeated readings."""

from ashlar.operators import findings
from ashlar.plans.findings import QUERIES

SMOKE = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_small_tables_are_broadcast(spark):
    """Two projects, or a policy of a few rules, are no keys to shuffle findings by (F21)."""
    got = plan(QUERIES["row_level_security"](spark, SMOKE))
    assert "hashpartitioning(project_key" not in got.split("BroadcastHashJoin")[1] and "SortMergeJoin [project_key" not in got
    rows = spark.createDataFrame([("rule_6", "RAG/Vector DB", 2, "m", "docs", None)], "rule string, category string, severity int, match string, context string, policy_status string")
    lists = spark.createDataFrame([("rule_6", "approved")], "rule string, policy_list string")
    assert "hashpartitioning(rule" not in plan(findings.with_policy(rows, lists))


def test_records_are_read_once(spark):
    """Entries and counters take what they count from the record itself: its text is parsed once (F14, F19)."""
    import json

    from ashlar.operators import entries

    texts = [json.dumps({"repos": ["a"], "findings": [{"repo": "a", "_hash": f"h{i % 3}"}]}) for i in range(40)]
    records = entries.read(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, record string"))
    triage = spark.createDataFrame([("h1", "false_positive")], "hash string, status string")
    made = entries.repo_entries(records, ["id"])
    counted = entries.rule_counters(records, triage, ["id"])
    assert plan(made).lower().count("parsejson(") == plan(counted).lower().count("parsejson(") == 1 and "Exchange" not in plan(made)
    assert [tuple(r) for r in counted.collect()] == [("unknown", 27, 13, 40)]


def test_short_cycles_send_lists(spark):
    """Paths are sent as lists; a node of more ends than a list holds loses none (F22)."""
    from ashlar.operators import portfolio

    arcs = {("hub", f"n{i:03}") for i in range(150)} | {(f"n{i:03}", "hub") for i in range(0, 150, 3)} | {(f"n{i:03}", f"n{i - 1:03}") for i in range(1, 150)}
    got = portfolio.short_cycles(spark.createDataFrame(sorted(arcs), "src string, dst string"))
    assert "array_intersect" in plan(got)
    want = [f"{a} -> {b} -> {a}" for a, b in arcs if a < b and (b, a) in arcs]
    want += [f"{a} -> {b} -> {c} -> {a}" for a, b in arcs if a < b for x, c in arcs if x == b and a < c and (c, a) in arcs]
    assert sorted(r["cycle"] for r in got.collect()) == sorted(want) and len(want) == 100


def test_review_reads_findings_once_to_ask(spark, tmp_path):
    """Both passes of a review read what is asked, written once (F20)."""
    from pyspark.sql import functions as F

    from ashlar.operators import two_pass
    from ashlar.plans.reviews import challenger, reviewer

    seen = spark.sparkContext.accumulator(0)
    counted = F.udf(lambda x: seen.add(1) or x, "string")
    rows = spark.range(20).select(
        F.col("id").cast("int").alias("line"), F.lit("f").alias("file"), F.lit("r").alias("rule"), F.lit("c").alias("category"), F.lit("docs").alias("context"), F.lit(2).alias("severity"), F.lit(50).alias("confidence"),
        F.lit("p").alias("capability"), F.lit("d").alias("description"), counted(F.concat(F.lit("m"), "id")).alias("snippet"),
    )
    got = two_pass.review_twice(rows, reviewer, challenger, str(tmp_path / "ledger"), "m", wait=0.0)
    asked = seen.value
    assert got.count() == 18 and asked == 20


def test_entropy_shrinks_the_text(spark):
    """Each character is taken out of what is left, not out of the whole text (F23)."""
    import math
    from collections import Counter

    from pyspark.sql import functions as F

    from ashlar.functions.text import entropy

    texts = ["", None, "a", "aab", "a.b\\$ü😀😀" * 30, "\n \n\t"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", entropy(F.col("t")).alias("bits"))
    assert "rest" in plan(df)
    for t, bits in df.collect():
        want = -sum(k / len(t) * math.log2(k / len(t)) for k in Counter(t).values()) if t else 0.0
        assert abs(bits - want) < 1e-9
