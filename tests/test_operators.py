"""Operators that SQL does not cover: cycles, review, streams, sinks, records."""

import json
import random

from ashlar.operators import findings, logs, portfolio, review
from ashlar.sources import records, sinks
from ashlar.streaming import streams


def test_first_wins_keeps_rows_without_key(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("", 3), ("", 4), (None, 5)], "hash string, seq int")
    assert sorted((r["hash"] or "", r["seq"]) for r in findings.first_wins(df, "hash", ["seq"]).collect()) == [("", 3), ("", 4), ("", 5), ("a", 1)]


def test_import_cycles_are_back_edges(spark):
    edges = [("r", "a", "b"), ("r", "b", "c"), ("r", "c", "a"), ("r", "c", "c"), ("r", "d", "a"), ("q", "x", "y")]
    got = [tuple(r) for r in portfolio.import_cycles(spark.createDataFrame(edges, "group string, src string, dst string")).collect()]
    assert sorted(got) == [("r", "a -> b -> c -> a"), ("r", "c -> c")]


def test_import_cycles_equal_recursive_search(spark):
    """Random graphs against a recursive search over what the peeling leaves."""
    rng = random.Random(3)
    edges = {(f"g{g}", f"n{a:02}", f"n{b:02}") for g in range(12) for a, b in ((rng.randrange(14), rng.randrange(14)) for _ in range(rng.randint(5, 40)))}
    want = set()
    for g in sorted({e[0] for e in edges}):
        graph = {(a, b) for x, a, b in edges if x == g}
        for _ in range(portfolio.PEEL):
            graph = {e for e in graph if e[1] in {a for a, _ in graph}}
            graph = {e for e in graph if e[0] in {b for _, b in graph}}
        done = set()

        def visit(node, path, g=g, graph=graph, done=done):
            for b in sorted(y for x, y in graph if x == node):
                if b in path:
                    loop = path[path.index(b) :]
                    i = loop.index(min(loop))
                    want.add((g, " -> ".join([*loop[i:], *loop[:i], loop[i]])))
                elif b not in done:
                    visit(b, [*path, b])
            done.add(node)

        for start in sorted({a for a, _ in graph}):
            if start not in done:
                visit(start, [start])
    df = spark.createDataFrame(list(edges), "group string, src string, dst string")
    assert {tuple(r) for r in portfolio.import_cycles(df).collect()} == want and len(want) > 30
    pairs = {(a, b) for g, a, b in edges if g == "g3" and a != b}
    short = {r["cycle"] for r in portfolio.short_cycles(spark.createDataFrame(list(pairs), "src string, dst string")).collect()}
    two = {f"{a} -> {b} -> {a}" for a, b in pairs if a < b and (b, a) in pairs}
    three = {f"{a} -> {b} -> {c} -> {a}" for a, b in pairs for x, c in pairs if x == b and (c, a) in pairs and a < b and a < c}
    assert short == two | three


def test_band_join_equals_theta_join(spark):
    a = spark.createDataFrame([("f", i) for i in range(0, 100, 7)], "file string, line int")
    b = spark.createDataFrame([("f", i) for i in (3, 3, 20, 33, 90)], "file string, line int")
    got = {(r["line"], r["n_sinks"]) for r in findings.within_lines(a, b, ["file"]).collect()}
    want = {(x, n) for x in range(0, 100, 7) if (n := len({y for y in (3, 20, 33, 90) if x - 2 <= y <= x + 12}))}
    assert got == want


def test_review_salvages_and_applies(spark):
    rows = [(str(i), "rule", "docs", 40, "s", 2) for i in range(5)]
    df = spark.createDataFrame(rows, "id string, rule string, context string, confidence int, snippet string, severity int")
    answer = lambda group: "```json\n[" + ",".join(json.dumps({"id": r["id"], "verdict": ["dismiss", "downgrade", "nonsense", "keep"][int(r["id"]) % 4]}) for r in group) + (", {\"broken\"" if group[0]["id"] == "0" else "]") + "\n```"
    verdicts = review.review(df.filter(review.eligible()), answer)
    got = {r["id"]: r["severity"] for r in review.apply_verdicts(df, verdicts).collect()}
    assert got == {"1": 3, "2": 2, "3": 2}


def test_logs(spark):
    df = logs.parse(spark.createDataFrame([("s", 0, "[23:59:58] start"), ("s", 1, "no time"), ("s", 2, "[00:00:03] reviewed=4 dismissed: 1"), ("s", 3, "[00:00:09] reviewed=2 dismissed: 2")], "session string, seq int, text string"), "text")
    assert [r["ts"] for r in logs.clock(df, "session", "seq", "second_of_day").orderBy("seq").collect()] == [86398, 86398, 86403, 86409]
    stats = logs.review_stats(df, "session", "msg").first()
    assert (stats["reviewed"], stats["dismissed"], stats["dismissed_sum"], stats["skipped"]) == (6, 2, 3, None)


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"ts":"2026-01-01T00:00:00Z","session":"s","event_type":"x","value":1}\n{"ts":"2026-01-01T05:00:00Z","session":"s","event_type":"x","value":2}\n')
    streams.append(streams.tail(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination(120)
    (tmp_path / "in/b.json").write_text('{"ts":"2026-01-02T00:00:00Z","session":"t","event_type":"y","value":3}\n')
    streams.append(streams.tail(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination(120)
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    streams.keep_latest(streams.tail(spark, str(tmp_path / "in")), str(tmp_path / "latest"), str(tmp_path / "c2"), "session", "ts").awaitTermination(120)
    got = {r["session"]: r["value"] for r in streams.latest_table(spark, str(tmp_path / "latest"), streams.tail(spark, str(tmp_path / "in")).schema, "session", "ts").read().collect()}
    assert got == {"s": 2.0, "t": 3.0}
    query = streams.windowed_counts(streams.tail(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r["event_type"], r["n"]) for r in spark.table("w").collect()) == [("x", 2), ("y", 1)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q"\x07\nb', "p"), (2, None, "q")], "k int, t string, g string")
    sinks.write_csv(df, str(tmp_path / "c"), ["k", "t"])
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "c")).orderBy("k").collect()
    assert back[0]["t"] == 'a "q" \nb'
    sinks.replace_partitions(df, str(tmp_path / "p"), "g")
    sinks.replace_partitions(df.filter("g = 'p'").withColumn("k", df["k"] + 10), str(tmp_path / "p"), "g")
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "p")).collect()) == [2, 11]
    same = lambda x: sinks.fingerprint(x, ["k", "t"]).first()[0]
    assert same(df) == same(df.repartition(2)) == same(df.orderBy("t")) and len(same(df)) == 64
    assert len({same(df), same(df.limit(1)), same(df.limit(0)), same(df.unionByName(df)), same(df.withColumn("k", df["k"] + 1))}) == 5
    assert json.loads(sinks.envelope(df, {"scan": "s"}).first()["value"])["scan"] == "s"


def test_records(spark):
    rows = spark.createDataFrame([("s1", 1, '{"project":"P","n":2}'), ("s2", 2, "broken"), ("s3", 3, None), ("s4", 4, "[1]"), ("s5", 5, '{"n":"x"}')], "scan_id string, updated_at long, payload string")
    got = records.renamed(records.scan_records(rows, "project string, n int"), {"project": "project_key"})
    assert [(r["scan_id"], r["project_key"], r["n"]) for r in got.collect()] == [("s1", "P", 2), ("s5", None, None)]
    assert records.policy_lists(spark, {"approved_providers": ["a", "b"], "banned_providers": ["b"]}).count() == 2
