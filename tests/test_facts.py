"""Detectors and facts on small code files."""

import json

from pyspark.sql import functions as F

from ashlar.operators import facts, meet, rules, threats
from ashlar.sources import files as src


def frame(spark, rows):
    return spark.createDataFrame(rows, "repo string, path string, content string")


def test_comments_noise_exclusions_and_policy(spark):
    code = "# trust_remote_code = True\nx = load(trust_remote_code=True)\ncur.execute('select %s', (x,))\neval(response)\n"
    df = frame(spark, [("r", "src/a.py", code), ("r", "gen/a.py", code)])
    got = rules.detect(df, exclude=((r"^gen/", "unsafe_code_exec"),), deny=(r"trust_remote_code",), allow=(r"^eval",)).collect()
    seen = {(g["path"], g["rule"], g["line"]): g["policy_status"] for g in got}
    assert seen[("src/a.py", "trust_remote_code", 2)] == "DENIED" and ("src/a.py", "trust_remote_code", 1) not in seen
    assert seen[("src/a.py", "unsafe_code_exec", 4)] == "ALLOWED" and not any(k[0].startswith("gen") and k[1] == "unsafe_code_exec" for k in seen)
    assert not any(k[1] == "sql_injection_direct" for k in seen)
    assert all("trust" in g["snippet"] for g in got if g["line"] == 2)  # snippets show the raw text


def test_notebook_bundle_deleted_and_clients(spark):
    key = "AKIA" + "ABCDEFGH12345678"
    book = {"cells": [{"cell_type": "code", "source": ["import openai\n", "# " + key], "outputs": [{"text": [key]}]}, {"cell_type": "markdown", "source": key}]}
    cells = src.notebook_cells(frame(spark, [("r", "n.ipynb", json.dumps(book)), ("r", "bad.ipynb", "{")]))
    got = {(g["path"], g["rule"], g["in_output"], g["confidence"] == 90) for g in rules.notebook_findings(cells).collect()}
    assert got == {("n.ipynb::cell[1]", "openai", False, False), ("n.ipynb::cell[1]", "aws_access_key", True, True)}
    files = frame(spark, [("r", "a.min.js", "var k='" + key + "';fetch('https://api.openai.com')"), ("r", "tests/b.min.js", key), ("r", "plain.js", key)])
    got = sorted((g["path"], g["severity"]) for g in rules.bundle_findings(files).collect())
    assert got == [("a.min.js", 1), ("a.min.js", 2), ("tests/b.min.js", 3)]
    gone = spark.createDataFrame([("r", "src/x.py", "c1", f"k = '{key}'", "[DELETED]src/x.py")], "repo string, path string, commit string, content string, label string")
    got = rules.deleted_file_findings(gone).filter("rule = 'aws_access_key'").first()
    assert (got["severity"], got["policy_status"], got["context"]) == (1, "CRITICAL", "deleted_file")
    files = frame(spark, [("r", "m.py", "client = OpenAI()\n"), ("r", "u.py", "from m import client\nclient.create(x)"), ("r", "v.py", "from m import client\n"), ("q", "u.py", "from m import client\nclient.create(x)")])
    assert [(g["path"], g["provider"], g["source"]) for g in rules.cross_file_clients(files).collect()] == [("u.py", "openai", "m.py")]


def test_imports_and_paths(spark):
    files = frame(spark, [("r", "a/b.py", "import c.d\nfrom e import x"), ("r", "z/c/d.py", ""), ("r", "y/c/d.py", ""), ("r", "e/__init__.py", "import a.b"), ("r", "w/x.js", "import t from '../u/./t'\nrequire('./v')"), ("r", "u/t.ts", ""), ("r", "w/v/index.js", ""), ("q", "c/d.py", "")])
    got = {(g["src"], g["dst"]) for g in facts.import_edges(files).collect()}
    assert got == {("a/b.py", "y/c/d.py"), ("a/b.py", "e/__init__.py"), ("e/__init__.py", "a/b.py"), ("w/x.js", "u/t.ts"), ("w/x.js", "w/v/index.js")}
    rel = spark.createDataFrame([("a/b/c.js", "../../x"), ("c.js", "../x"), ("a/c.js", "./d/../e")], "p string, t string")
    assert [r[0] for r in rel.select(facts.resolve_relative(F.col("p"), F.col("t"))).collect()] == ["x", "x", "a/e"]
    names = spark.createDataFrame([("llama-7b-chat",), ("tiny-350m",), ("gpt",), ("x1.5B",), ("v-15.7B",)], "m string")
    assert [r[0] for r in names.select(facts.model_billions(F.col("m"))).collect()] == [7.0, 0.35, None, None, 15.7]
    assert facts.rescan_scope(None, files).count() == 8 and facts.rescan_scope(files.limit(0), files).count() == 0


def test_threats_of_an_empty_table(spark):
    none = spark.createDataFrame([], "repo string, file string, rule string, category string, severity int, context string")
    assert threats.finding_threats(none).count() == threats.architecture_threats(none).count() == threats.diagram(none).count() == 0


def test_rows_of_one_key_meet_in_pieces(spark):
    a = spark.createDataFrame([("k" if i % 10 else f"x{i}", i) for i in range(300)] + [(None, 1), ("only", 2)], "k string, i int")
    b = spark.createDataFrame([("k", j) for j in range(50)] + [("k", 3), ("x20", 1), ("x20", 1), (None, 2)], "k string, j int")
    got = meet.meet(a, b, ["k"], side=8)
    order = lambda df: sorted((r["k"], r["i"], r["j"]) for r in df.collect())
    assert order(got) == order(a.join(b, ["k"])) and got.rdd.getNumPartitions() > 1
    sizes = [x for x in got.rdd.glom().map(len).collect() if x]
    assert len(sizes) > 20 and max(sizes) < 0.2 * sum(sizes)
