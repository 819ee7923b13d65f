"""Calls on variables that hold a model client: bindings, calls, and which binding a call has."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import match_array, path_class, strip_comments
from . import rules
from .rules import SEC, detect, high_entropy

#: Constructors in the order in which later ones win, and the methods that call a model.
CONSTRUCTORS = (
    (r"OpenAI\s*\(", "openai"), (r"AsyncOpenAI\s*\(", "openai"), (r"AzureOpenAI\s*\(", "azure_openai"), (r"anthropic\.Anthropic\s*\(", "anthropic"), (r"Anthropic\s*\(", "anthropic"),
    (r"cohere\.Client\s*\(", "cohere"), (r"MistralClient\s*\(", "mistral_ai"), (r"Groq\s*\(", "groq"), (r"genai\.GenerativeModel\s*\(", "google_gemini_vertexai"), (r"ChatOpenAI\s*\(", "openai"),
    (r"ChatAnthropic\s*\(", "anthropic"), (r"litellm\b", "litellm"), (r"Portkey\s*\(", "portkey"), (r"new\s+OpenAI\s*\(", "openai_js"), (r"new\s+Anthropic\s*\(", "anthropic_js"),
)
METHODS = ("chat.completions.create", "completions.create", "messages.create", "generate", "invoke", "predict", "stream", "agenerate", "ainvoke", "astream", "achat", "agenerate_text", "complete")
_CALL = rf"(?i)\w+\.(?:{'|'.join(m.replace('.', '[.]') for m in METHODS)})\s*\("


def _holds(c: Column, literals: list[str]) -> Column:
    """The text has one of the literals, case aside: the cheap test before a pattern that tries every word."""
    return F.transform(F.array(F.lower(c)), lambda low: reduce(or_, [F.contains(low, F.lit(x)) for x in literals]))[0]


def bindings(c: Column, constructors=CONSTRUCTORS) -> Column:
    """Array of (var, provider, ordinal, start) of the assignments in a text; case is ignored."""
    heads = [None if "|" in p else re.match(r"(?:new\\s\+)?((?:\w|\\\.)+?)(?=\\[sb]|$)", p) for p, _ in constructors]
    tested = _holds(c, sorted({h[1].replace("\\", "").lower() for h in heads})) if all(heads) else F.lit(True)
    every = rf"(?i)\w+\s*=\s*(?:{'|'.join(p for p, _ in constructors)})"

    def one(m: Column) -> Column:
        ordinal, provider = F.lit(-1), F.lit(None).cast("string")
        for i, (pattern, name) in enumerate(constructors):
            hit = m["match"].rlike(rf"(?i)^\w+\s*=\s*{pattern}")
            ordinal, provider = F.when(hit, i).otherwise(ordinal), F.when(hit, name).otherwise(provider)
        return F.struct(F.regexp_extract(m["match"], r"^(\w+)", 1).alias("var"), provider.alias("provider"), ordinal.alias("ordinal"), m["start"].alias("start"))

    return F.transform(F.when(tested, match_array(c, every)), one)


def calls(c: Column) -> Column:
    """Array of (var, method, start, line, match) of the model calls in a text."""
    return F.transform(F.when(_holds(c, [f".{m}" for m in METHODS]), match_array(c, _CALL)), lambda m: F.struct(
        F.regexp_extract(m["match"], r"^(\w+)", 1).alias("var"), F.regexp_extract(m["match"], r"^\w+\.(.*?)\s*\($", 1).alias("method"), m["start"].alias("start"), m["line"].alias("line"), m["match"].alias("match")))


def tracked_calls(texts: DataFrame, key: list[str], text: str = "content", order: Column | None = None, scope: list[str] | None = None) -> DataFrame:
    """The key, var, method, provider, line and match of each call on a variable that holds a client.

    Within a text (``key``) the assignment that counts is the last one of the last
    constructor that the variable is given, wherever it stands. With ``scope`` (columns of
    ``key``) and ``order`` a call sees all texts of the scope up to itself, as cells that run one
    after another: the latest assignment before it counts, by order, then place.

    Bindings and calls are found in the row; their positions alone are joined.
    """
    at = F.lit(0) if order is None else order
    rows = texts.withColumn("__at", at)
    made = rows.select(*key, "__at", F.explode(bindings(F.col(text))).alias("b")).select(*key, "__at", "b.*")
    used = rows.select(*key, "__at", F.explode(calls(F.col(text))).alias("c")).select(*key, "__at", "c.*")
    if scope is None:
        last = made.groupBy(*key, "var").agg(F.max_by("provider", F.struct("ordinal", "start")).alias("provider"))
        return used.join(last, [*key, "var"]).select(*key, "var", "method", "provider", "line", "match")
    made = made.select(*scope, "var", "provider", F.struct(F.col("__at").alias("at"), F.col("start").alias("start")).alias("bound"))
    used = used.withColumn("called", F.struct(F.col("__at").alias("at"), F.col("start").alias("start")))
    # only the variables of one scope meet, and the latest binding is kept while they do
    got = used.join(made, [*scope, "var"]).filter("bound < called")
    return got.groupBy(*key, "var", "method", "line", "match", "called").agg(F.max_by("provider", "bound").alias("provider")).select(*key, "var", "method", "provider", "line", "match")


def symbol_findings(texts: DataFrame, key: list[str], confidence: int = 55, **how) -> DataFrame:
    """``tracked_calls`` as findings of severity 2."""
    got = tracked_calls(texts, key, **how)
    return got.select(*key, F.col("provider").alias("rule"), F.lit(rules.API).alias("category"), F.concat(F.lit("Call of "), "var", F.lit("."), "method").alias("capability"), F.lit(2).alias("severity"), "line", F.substring("match", 1, 300).alias("match"), F.lit(confidence).alias("confidence"), F.lit("REVIEW").alias("policy_status"))


OUTPUT_SECRET = r"(?i)\b(?:api[_-]?key|auth[_-]?token|access[_-]?token|bearer[_-]?token|secret[_-]?key|private[_-]?key|sk-(?:ant-)?[A-Za-z0-9_-]{10,}|(?:authorization|password|passwd|api[_-]?secret)\s*[=:])"


def notebook_scan(cells: DataFrame, catalogue=rules.RULES, least: float = 4.5, across: bool = False, outputs: str = OUTPUT_SECRET) -> DataFrame:
    """All findings of notebooks (repo, path, cell, content, outputs): kind, repo, path,
    cell, rule, severity, line, match, confidence, context.

    kind is rule (the rules for code over each cell without comments; a guard holds if any cell of the
    notebook has it), symbol (calls on clients; bound in the same cell, or with ``across`` in any
    cell before), entropy (literals of many bits, severity 1) or output (a text that a cell
    printed and that looks like a secret, severity 1). Security rules are a level lower than in
    files, and rules two levels in tests.
    """
    code = tuple(r for r in catalogue if not r.config_only and not r.path)
    key = ["repo", "path", "cell"]
    test = path_class(F.col("path")) == "test"
    guards = sorted({r.guard for r in code if r.guard})
    held = F.array_compact(F.array(*[F.when(F.col("content").rlike(g), F.lit(g)) for g in guards])) if guards else F.array().cast("array<string>")
    per_book = cells.select("repo", "path", F.explode_outer(held).alias("g")).groupBy("repo", "path").agg(F.collect_set("g").alias("held"))  # as many as the catalogue has guards
    plain = cells.withColumn("content", strip_comments(F.col("content"), "python"))
    named = plain.join(per_book, ["repo", "path"]).withColumn("path", F.concat("path", F.lit("::cell["), F.col("cell").cast("string"), F.lit("]")))
    cut = lambda i: F.regexp_extract("path", r"^(.*)::cell\[(\d+)\]$", i)
    found = detect(named.select("repo", "path", "content", "held"), code, bump=False, stripped=False, noise={}, held="held").select("repo", cut(1).alias("path"), cut(2).cast("int").alias("cell"), "rule", "category", "severity", "line", "match", "confidence")
    lower = F.when(F.col("category") == SEC, 1).otherwise(0) + F.when(test, 2).otherwise(0)
    context = F.when(test, "test").otherwise("production")
    out = lambda rows, kind, rule, severity, line, match, sure: rows.select(F.lit(kind).alias("kind"), *key, rule.alias("rule"), severity.cast("int").alias("severity"), line.alias("line"), match.alias("match"), sure.cast("int").alias("confidence"), context.alias("context"))
    how = {"order": F.col("cell"), "scope": ["repo", "path"]} if across else {}
    symbols = symbol_findings(plain, key, **how)
    many_bits = high_entropy(cells.withColumn("path", F.concat("path", F.lit("::cell["), F.col("cell").cast("string"), F.lit("]"))), least).select("repo", cut(1).alias("path"), cut(2).cast("int").alias("cell"), "line", "value")
    printed = cells.select(*key, F.explode("outputs").alias("o")).filter(F.col("o").rlike(outputs)).dropDuplicates(["repo", "path", "o"])
    return (
        out(found, "rule", F.col("rule"), F.least(F.col("severity") + lower, F.lit(4)), F.col("line"), F.col("match"), F.col("confidence"))
        .unionByName(out(symbols, "symbol", F.col("rule"), F.lit(2), F.col("line"), F.col("match"), F.lit(55)))
        .unionByName(out(many_bits, "entropy", F.lit("entropy_secret"), F.lit(1), F.col("line"), F.col("value"), F.lit(80)))
        .unionByName(out(printed, "output", F.lit("notebook_output_secret"), F.lit(1), F.lit(0), F.substring("o", 1, 200), F.lit(90)).withColumn("context", F.lit("production")))
    )
