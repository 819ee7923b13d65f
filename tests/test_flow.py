"""Flows over lines, symbol tables and notebooks against plain Python."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ashlar.operators import flow, symbols
from ashlar.operators.rules import SEC, Rule
from ashlar.plans import flows


def frame(spark, rows):
    return spark.createDataFrame(rows, "repo string, path string, content string")


def test_bisection(spark):
    rng = random.Random(1)
    rows = [(sorted(rng.sample(range(60), rng.randint(0, 40))), rng.randrange(-5, 70)) for _ in range(200)]
    df = spark.createDataFrame(rows, "v array<int>, x int").select("v", "x", flow.first_from(F.col("v"), F.col("x")).alias("got"))
    assert all(r["got"] == next((v for v in r["v"] if v >= r["x"]), None) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_flows_equal_windows_of_text(spark, seed):
    rng = random.Random(seed)
    rules = (Rule("a", SEC, "A", 2, r"read\(\w*\)", guard="llm"), Rule("b", "X", "B", 3, r"get\(\w*\)|read\(z\)"))
    rows = []
    for i in range(40):
        lines = [rng.choice(["", "", "", "", "x", f"read({rng.choice('pqz')})", f"get({rng.choice('pq')})", "prompt =", "llm", "# prompt ="]) for _ in range(60)]
        rows.append(("r", f"{rng.choice(['src', 'tests'])}/f{i}.py", "\n".join(lines)))
    got = sorted((r["path"], r["rule"], r["line"], r["match"], r["severity"], r["snippet"]) for r in flow.data_flows(frame(spark, rows), rules, "prompt =", 2, 5).collect())
    want = []
    for _, path, text in rows:
        code = re.sub(r"# prompt =", "          ", text).split("\n")
        seen = set()
        for r in rules:
            if r.guard and r.guard not in text:
                continue
            for n, line in enumerate(code):
                for m in re.finditer(r.pattern, line):
                    window = code[max(0, n - 2) : n + 6]
                    if any("prompt =" in x for x in window) and m[0] not in seen:
                        seen.add(m[0])
                        want.append((path, r.slug, n + 1, m[0], min(4, r.severity + 2 * path.startswith("tests")), "\n".join(text.split("\n")[max(0, n - 2) : n + 6])))
    assert got == sorted(want) and len(want) > 20


def test_catalogue_of_sources(spark):
    calls = {"file_content_to_llm": "x = open(p).read()", "dataframe_to_llm": "d = pd.read_csv('f')", "env_vars_to_llm": "k = os.getenv('A')", "db_results_to_llm": "cur.fetchall()", "http_response_to_llm": "requests.post(u)"}
    files = [("r", f"{slug}.py", f"import openai\n{line}\n" + "\n" * 5 + "client.chat.completions.create(messages=[])") for slug, line in calls.items()]
    files += [("r", "far.py", "import openai\nos.getenv('A')" + "\n" * 14 + "prompt = 1"), ("r", "unguarded.py", "os.getenv('A')\nprompt = 1"), ("r", "null.py", None), ("r", "empty.py", "")]
    got = {(r["path"], r["rule"], r["severity"], r["confidence"], r["policy_status"]) for r in flow.data_flows(frame(spark, files)).collect()}
    assert got == {(f"{s}.py", s, 3 if s == "http_response_to_llm" else 2, 70, "CRITICAL") for s in calls}


def test_secret_counts_only_beside_prompts(spark):
    files = frame(spark, [("r", "a.py", "handle(user_input)"), ("r", "b.py", "nothing")])
    found = spark.createDataFrame([("r", p, rule, n, "production") for p in ("a.py", "b.py") for n, rule in enumerate(("hardcoded_key", "openai"), 1)], "repo string, path string, rule string, line int, context string")
    got = flow.secret_beside_model(found, files, F.col("rule") == "hardcoded_key", F.col("rule") == "openai").collect()
    assert [(r["path"], r["line"], r["evidence"], r["severity"], r["signal"]) for r in got] == [("a.py", 1, "hardcoded_key,openai", 1, "user_input")]


def test_query_of_secrets_takes_configuration_files(spark, tmp_path):
    rows = [(1, f'x est\ntoken = "{"0a" * 20}" a@b.example', "es", "s"), (2, "a@b.example est", "es", "s"), (3, None, "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = flows.QUERIES["secret_beside_model"](spark, str(tmp_path)).collect()
    assert [(r["path"], r["line"], r["evidence"]) for r in got] == [("docs/d1.yaml", 2, "hardcoded_credential,email_address")]


def plain_table(text):
    table = {}
    for pattern, provider in symbols.CONSTRUCTORS:
        for m in re.finditer(rf"(?i)(\w+)\s*=\s*{pattern}", text):
            table[m[1]] = provider
    return table


@pytest.mark.parametrize("seed", [1, 2])
def test_symbol_tables(spark, seed):
    rng = random.Random(seed)
    ctor = ["OpenAI(", "azureopenai (", "anthropic.Anthropic(", "Groq(", "new  OpenAI(", "litellm", "litellmx", "Other(", "ChatAnthropic("]
    line = lambda: f"{rng.choice('abc')} = {rng.choice(ctor)}" if rng.random() < 0.5 else f"x.{rng.choice('abcd')}.{rng.choice([*symbols.METHODS, 'close', 'Invoke'])}(y)"
    rows = [("r", f"f{i}.py", "\n".join(line() for _ in range(rng.randint(0, 12)))) for i in range(60)]
    got = sorted((r["path"], r["line"], r["var"], r["provider"]) for r in symbols.tracked_calls(frame(spark, rows), ["repo", "path"]).collect())
    call = rf"(?i)(\w+)\.({'|'.join(map(re.escape, symbols.METHODS))})\s*\("
    want = []
    for _, path, text in rows:
        table = plain_table(text)
        want += [(path, text[: m.start()].count("\n") + 1, m[1], table[m[1]]) for m in re.finditer(call, text) if m[1] in table]
    assert got == sorted(want) and len(want) > 30


def test_bindings_across_cells_go_by_order(spark):
    cells = spark.createDataFrame([("r", "n", 1, "a = OpenAI()"), ("r", "n", 2, "a.invoke(1)\na = Groq()\na.invoke(2)"), ("r", "n", 3, "a.invoke(3)\nb.invoke(4)"), ("r", "n", 4, "b = OpenAI()"), ("r", "m", 5, "a.invoke(5)")], "repo string, path string, cell int, content string")
    key = ["repo", "path", "cell"]
    got = {(r["path"], r["cell"], r["line"]): r["provider"] for r in symbols.tracked_calls(cells, key, order=F.col("cell"), scope=["repo", "path"]).collect()}
    assert got == {("n", 2, 1): "openai", ("n", 2, 3): "groq", ("n", 3, 1): "groq"}
    own = {(r["cell"], r["line"]): r["provider"] for r in symbols.tracked_calls(cells, key).collect()}
    assert own == {(2, 1): "groq", (2, 3): "groq"}


def test_notebook_scan(spark):
    data = defaultdict(list)
    rules = (Rule("plain", "API", "p", 2, "call1"), Rule("guarded", SEC, "g", 1, "call2", guard="llmlib"), Rule("config", "API", "c", 2, "call1", config_only=True))
    bits = 'token = "aB3$kL9!mQ2@xZ7#pW5%rT8&"'
    cells = spark.createDataFrame(
        [("r", "nb.ipynb", 1, "import llmlib", []), ("r", "nb.ipynb", 2, "x\ncall1\n# call2", []), ("r", "nb.ipynb", 3, "call2\nc = OpenAI()\nc.invoke()", ["ok", "api_key: 12345"]), ("r", "tests/t.ipynb", 1, "call1\ncall2", []), ("r", "e.ipynb", 1, bits, ["password= 1", "password= 1"]), ("r", "z.ipynb", 1, "", [])],
        "repo string, path string, cell int, content string, outputs array<string>",
    )
    for r in symbols.notebook_scan(cells, rules, 4.0).collect():
        data[r["kind"]].append((r["path"], r["cell"], r["line"], r["rule"], r["severity"], r["context"]))
    assert sorted(data["rule"]) == [("nb.ipynb", 2, 2, "plain", 2, "production"), ("nb.ipynb", 3, 1, "guarded", 2, "production"), ("tests/t.ipynb", 1, 1, "plain", 4, "test")]
    assert data["symbol"] == [("nb.ipynb", 3, 3, "openai", 2, "production")]
    assert data["entropy"] == [("e.ipynb", 1, 1, "entropy_secret", 1, "production")]
    assert sorted(data["output"]) == [("e.ipynb", 1, 0, "notebook_output_secret", 1, "production"), ("nb.ipynb", 3, 0, "notebook_output_secret", 1, "production")]
