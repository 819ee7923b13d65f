"""What a scan leaves out: snippets nobody asks for, sources of one text, texts without a client."""

from pyspark.sql import functions as F

from ashlar.operators import flow, scan, symbols

FILES = [("r", "a.py", "x = open(p).read()\nopenai\ny = open(p).read()\nllm.invoke(x)\ntoken = \"abcdefgh12345\"\n"), ("r", "b.py", "c = gROQ (k)\nc.Messages.Create(x)\n")]


def _files(spark):
    return spark.createDataFrame(FILES, "repo string, path string, content string")


def test_scan_without_snippets_has_the_same_findings(spark):
    full, bare = scan.scan(_files(spark)), scan.scan(_files(spark), snippets=False)
    rows = lambda df: sorted(map(str, df.drop("snippet").collect()))
    assert rows(full) == rows(bare) and full.filter("detector = 'flow' and snippet <> ''").count() == 1
    assert bare.filter("snippet <> ''").count() == 0


def test_sources_of_one_text_leave_the_row_once(spark):
    hits = "array(struct(1 as ordinal, 9 as start, 3 as line, 'a  b' as match), struct(0 as ordinal, 5 as start, 2 as line, 'a b ' as match), struct(1 as ordinal, 7 as start, 3 as line, 'c' as match))"
    got = spark.range(1).select(F.expr(hits).alias("h")).select(F.explode(flow.first_of_each(F.col("h"))).alias("m")).select("m.*")
    assert sorted((r["ordinal"], r["start"], r["match"]) for r in got.collect()) == [(0, 5, "a b "), (1, 7, "c")]


def test_clients_are_found_whatever_their_case(spark):
    got = symbols.tracked_calls(_files(spark), ["repo", "path"]).collect()
    assert [(r["var"], r["provider"], r["line"]) for r in got] == [("c", "groq", 2)]


def test_constructors_without_a_literal_head_are_found(spark):
    df = _files(spark).select(symbols.bindings(F.col("content"), ((r"(?:x|groq)\s*\(", "a"), (r"nothing\s*\(", "b"))).alias("b"))
    assert [b["var"] for r in df.collect() for b in r["b"] or []] == ["c"]
