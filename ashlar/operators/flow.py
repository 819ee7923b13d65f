"""Data that flows toward a model over several lines, and secrets beside model calls.

Sources and sinks are matched once a text; both are sorted positions within the row, and for
each source the first sink at or after its window's start is found by bisection. Only
sources with a sink in the window leave the row, so a text is copied for no match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import match_array, normal_match, path_class, stable_id
from .findings import secret_flow
from .rules import SEC, Rule, around, code_text

_MODEL = r"(?i)openai|anthropic|langchain|litellm|llm|chat|completion"
#: Slugs and severities are fixed values, patterns this package's own.
SOURCES = (
    Rule("file_content_to_llm", SEC, "File content reaches a model", 2, r"(?i)\bopen\([^)\n]*\)\.read(?:lines)?\(|\.read_(?:text|bytes)\(", guard=_MODEL),
    Rule("dataframe_to_llm", SEC, "Table content reaches a model", 2, r"(?i)\bread_(?:csv|excel|sql|parquet)\(|\.to_(?:string|json)\(", guard=_MODEL),
    Rule("env_vars_to_llm", SEC, "Environment reaches a model", 2, r"(?i)\bos\.(?:environ\b|getenv\()", guard=_MODEL),
    Rule("db_results_to_llm", SEC, "Query results reach a model", 2, r"(?i)\.(?:execute|fetchall|fetchone|query)\(", guard=_MODEL),
    Rule("http_response_to_llm", SEC, "Web response reaches a model", 3, r"(?i)\b(?:requests|httpx)\.(?:get|post|put|patch)\(|\burllib\.request\.", guard=_MODEL),
)
SINK = r"(?i)\.(?:chat\.)?completions\.|\.messages\.create|litellm\.completion|anthropic\.|langchain|\bllm\.(?:invoke|predict|generate)|\b(?:prompt|messages)\s*[+=]|\b(?:system_prompt|user_message)\b|\b(?:Human|System|AI)Message\b|PromptTemplate"
PROMPT = r"(?i)\b(?:prompt|messages|user[_ -]?input|request|response|output|content|chat_history|context|stream)\b|\binput\s*\(|flask|fastapi|gradio|streamlit"
BEFORE, AFTER = 2, 12
_STEPS = [1 << i for i in range(24, -1, -1)]


def first_from(values: Column, least: Column) -> Column:
    """The first of sorted ``values`` that is not below ``least``, by bisection; null if all are."""
    below = F.aggregate(F.array(*[F.lit(s) for s in _STEPS]), F.lit(0), lambda at, s: F.when(F.get(values, at + s - 1) < least, at + s).otherwise(at))
    return F.get(values, below)


def lines_of(c: Column, pattern: str) -> Column:
    """Sorted distinct lines on which a pattern matches."""
    return F.array_sort(F.array_distinct(F.transform(match_array(c, pattern), lambda m: m["line"])))


def first_of_each(hits: Column) -> Column:
    """Of hits with the same match, white space aside, the first by ordinal and start; by sorting, so that many hits are no square."""
    named = F.array_sort(F.transform(hits, lambda m: F.struct(normal_match(m["match"]).alias("name"), m["ordinal"].alias("ordinal"), m["start"].alias("start"), m["line"].alias("line"), m["match"].alias("match"))))
    return F.transform(F.array(named), lambda s: F.filter(s, lambda m, i: ~m["name"].eqNullSafe(F.get(s, i - 1)["name"])))[0]


def data_flows(files: DataFrame, sources: tuple[Rule, ...] = SOURCES, sink: str = SINK, before: int = BEFORE, after: int = AFTER, stripped: bool = True, snippets: bool = True) -> DataFrame:
    """Sources in ``files`` (repo, path, content) with a sink from ``before`` lines above to ``after`` below.

    repo, path, rule, category, capability, severity, context, line, match, snippet, id,
    confidence, policy_status. A source counts if its rule's guard holds in the file; of
    sources of one text in a file the first by rule and place stays. Severity is two
    lower in tests. Comments don't count where ``stripped``. Sources of one text are made one within
    the row, before their lines are copied; without ``snippets`` none are copied.
    """
    code = code_text(F.col("path"), F.col("content")) if stripped else F.col("content")
    rows = files.filter(F.col("content").rlike(sink)).select("repo", "path", "content", code.alias("code"))
    guards = [F.coalesce(F.col("code").rlike(r.guard), F.lit(False)) if r.guard else F.lit(True) for r in sources]

    def of(i: int, r: Rule, t: Column) -> Column:
        near = lambda m: first_from(t["sinks"], m["line"] - before) <= m["line"] + after
        kept = F.filter(t[f"m{i}"], near)
        return F.transform(kept, lambda m: F.struct(F.lit(i).alias("ordinal"), m["start"].alias("start"), m["line"].alias("line"), m["match"].alias("match")))

    # one-element transforms bind what is used for every match, so that it is made once a text
    bound = F.struct(lines_of(F.col("code"), sink).alias("sinks"), *[F.coalesce(F.when(g, match_array(F.col("code"), r.pattern)), F.array()).alias(f"m{i}") for i, (r, g) in enumerate(zip(sources, guards, strict=True))])
    hits = F.transform(F.array(bound), lambda t: F.flatten(F.array(*[of(i, r, t) for i, r in enumerate(sources)])))[0]
    rows = rows.withColumn("hits", first_of_each(hits))
    lines = F.split("content", "\n", -1) if snippets else F.array().cast("array<string>")
    shown = F.transform(F.array(F.struct(lines.alias("x"), F.col("hits").alias("h"))), lambda t: F.transform(t["h"], lambda m: F.struct(m["ordinal"].alias("ordinal"), m["start"].alias("start"), m["line"].alias("line"), m["match"].alias("match"), around(t["x"], m["line"], before, after, 200).alias("snippet"))))[0]
    found = rows.select("repo", "path", F.explode(shown).alias("m")).withColumn("id", stable_id(F.col("repo"), F.col("path"), F.lit("ml"), F.col("m.match")))
    found = found.groupBy("repo", "path", "id").agg(F.min_by("m", F.struct("m.ordinal", "m.start")).alias("m"))
    of_rule = lambda name: F.element_at(F.array(*[F.lit(getattr(r, name)) for r in sources]), F.col("m.ordinal") + 1)
    test = path_class(F.col("path")) == "test"
    return found.select(
        "repo", "path", of_rule("slug").alias("rule"), of_rule("category").alias("category"), F.concat(of_rule("label"), F.lit(" (multi-line)")).alias("capability"),
        F.least(of_rule("severity") + F.when(test, 2).otherwise(0), F.lit(4)).alias("severity"), F.when(test, "test").otherwise("production").alias("context"),
        "m.line", F.substring("m.match", 1, 300).alias("match"), "m.snippet", "id", F.lit(70).alias("confidence"),
        F.when(of_rule("category") == SEC, "CRITICAL").otherwise("REVIEW").alias("policy_status"),
    )


def secret_beside_model(findings: DataFrame, files: DataFrame, secret: Column, usage: Column, prompt: str = PROMPT) -> DataFrame:
    """One finding a file that holds a secret, a use of a model and handles prompts.

    ``secret_flow`` over the findings (repo, path, rule, line, context) of files whose text
    (repo, path, content) has the pattern ``prompt``; ``signal`` is its first match. Texts
    are scanned where they lie; only keys and signals are joined.
    """
    key = ["repo", "path"]
    signals = files.filter(F.col("content").rlike(prompt)).select(*key, F.regexp_extract("content", f"({prompt})", 1).alias("signal"))
    return secret_flow(findings, secret, usage, key).join(signals, key)
