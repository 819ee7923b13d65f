"""A scan as a whole: every detector over the files, one table of findings, policy, scores and delta."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.text import minified, path_class, stable_id
from ..sources.files import notebook_cells
from ..sources.shared import written
from . import findings as fd
from . import flow, rules, symbols
from .catalogue import ALL
from .rules import API, CODE, SEC
from .two_pass import refreshed

#: The order in which detectors are read: of two findings of one id the first by it stays.
DETECTORS = ("rule", "symbol", "entropy", "flow", "bundle", "notebook", "correlation", "client", "credential")
#: What counts as a secret and as a use of a model.
SECRETS = ("hardcoded_key", "hardcoded_credential", "openai_key_pattern", "anthropic_key_pattern", "js_hardcoded_key", "entropy_secret", "notebook_output_secret", "minified_bundle_secret")
USES = ("External AI API", "AI Proxy/Gateway", "Agent Framework", "RAG/Vector DB")
COLUMNS = ("repo", "path", "detector", "rule", "category", "capability", "severity", "context", "line", "start", "match", "snippet", "id", "confidence", "policy_status")


def _rows(df: DataFrame, detector: str, **given: Column) -> DataFrame:
    """``df`` with the columns of a finding; what it has none of is empty."""
    has = set(df.columns)
    empty = {"snippet": F.lit(""), "start": F.lit(0), "context": path_class(F.col("path")), "policy_status": F.lit("REVIEW"), "line": F.lit(1), "capability": F.lit("")}
    pick = lambda c: given[c] if c in given else F.lit(detector) if c == "detector" else F.col(c) if c in has else empty[c]
    types = {"severity": "int", "line": "int", "start": "int", "confidence": "int"}
    return df.select(*[pick(c).cast(types.get(c, "string")).alias(c) for c in COLUMNS])


def _less_in_tests(severity: Column) -> Column:
    return F.least(severity + F.when(path_class(F.col("path")).isin("test", "docs"), 2).otherwise(0), F.lit(4))


def scan(
    files: DataFrame, catalogue=ALL, sources=flow.SOURCES, sink: str = flow.SINK, prompt: str = flow.PROMPT, ignore: tuple[str, ...] = (), least_bits: float = 4.5,
    secrets: tuple[str, ...] = SECRETS, uses: tuple[str, ...] = USES, code: str = CODE, snippets: bool = True, **rule_options,
) -> DataFrame:
    """All findings of ``files`` (repo, path, content), one row an id, with their corroboration.

    Ignored paths are left out, notebooks are scanned by cell and bundles for keys alone; all
    others by rules, bindings of clients, literals of many bits, flows over lines, secrets
    beside models, and names that other files import. Files whose path ``code``
    matches are code. Of findings of one id the first in the order of ``DETECTORS``, of the
    catalogue, then by place, stays; the confidence of findings in a file of several rules is lifted.

    Each detector reads the texts where they lie; what is united, joined and made
    unique are findings, whose bulk are their snippets: without ``snippets`` these are empty.
    """
    if ignore:
        files = rules.ignored(files, list(ignore)).filter(~F.col("ignored")).drop("ignored")
    files = files.select("repo", "path", "content")
    book = F.col("path").endswith(".ipynb")
    bundle = ~book & minified(F.col("path"), F.col("content")) & F.lower("path").rlike(r"\.(js|ts)$")
    texts = files.filter(~book & ~F.coalesce(bundle, F.lit(False)))
    coded = texts.filter(F.lower("path").rlike(code))
    key = lambda *parts: stable_id(F.col("repo"), F.col("path"), *parts)

    by_rule = _rows(rules.detect(texts, catalogue, **rule_options), "rule")
    plain = coded.withColumn("content", rules.code_text(F.col("path"), F.col("content")))
    by_symbol = _rows(symbols.symbol_findings(plain, ["repo", "path"]), "symbol", id=key(F.lit("sym"), F.col("rule"), F.col("match")))
    by_bits = _rows(rules.high_entropy(texts, least_bits), "entropy", rule=F.lit("entropy_secret"), category=F.lit(SEC), capability=F.lit("Literal of many bits"), severity=_less_in_tests(F.lit(1)), match=F.col("value"), id=key(F.lit("bits"), F.col("value")), confidence=F.lit(75), policy_status=F.lit("CRITICAL"))
    by_flow = _rows(flow.data_flows(coded, sources, sink, snippets=snippets), "flow")
    keys = F.col("severity").isin(1, 3)
    by_bundle = _rows(rules.bundle_findings(files.filter(F.coalesce(bundle, F.lit(False)))), "bundle", rule=F.when(keys, "minified_bundle_secret").otherwise("minified_bundle_endpoint"), category=F.when(keys, SEC).otherwise(API), snippet=F.col("context"), context=path_class(F.col("path")), id=key(F.lit("bundle"), F.col("match")))
    cells = symbols.notebook_scan(notebook_cells(files.filter(book)), catalogue, least_bits)
    in_cell = F.concat("path", F.lit("::cell["), F.col("cell").cast("string"), F.lit("]"))
    category = F.element_at(F.create_map(*[F.lit(x) for r in catalogue for x in (r.slug, r.category)]), F.col("rule"))
    by_cell = _rows(cells, "notebook", path=in_cell, category=F.when(F.col("kind") == "rule", category).when(F.col("kind") == "symbol", API).otherwise(SEC), id=stable_id(F.col("repo"), in_cell, F.col("rule"), F.col("match")))

    # written once: what follows reads findings several times, but no text again for them
    found = reduce(DataFrame.unionByName, [by_rule, by_symbol, by_bits, by_flow, by_bundle, by_cell])
    found = written(found if snippets else found.withColumn("snippet", F.lit("")), "scan")
    beside = flow.secret_beside_model(found.filter(F.col("detector").isin("rule", "symbol", "entropy", "flow")), texts, F.col("rule").isin(*secrets), F.col("category").isin(*uses), prompt)
    beside = _rows(beside, "correlation", rule=F.lit("secret_ai_correlation"), category=F.lit(SEC), capability=F.lit("Secret beside model calls"), match=F.col("evidence"), id=key(F.lit("secret-ai"), F.col("evidence"), F.col("signal")), policy_status=F.when(F.col("severity") > 1, "REVIEW").otherwise("CRITICAL"))
    clients = _rows(rules.cross_file_clients(coded), "client", rule=F.col("provider"), category=F.lit(API), capability=F.concat(F.lit("Client of "), "source"), severity=_less_in_tests(F.lit(2)), match=F.col("name"), id=key(F.lit("client"), F.col("name")), confidence=F.lit(65))
    lent = _rows(rules.cross_file_credentials(coded), "credential", rule=F.lit("cross_file_credential"), category=F.lit(SEC), capability=F.concat(F.lit("Credential of "), "source"), severity=_less_in_tests(F.lit(1)), match=F.col("name"), id=key(F.lit("credential"), F.col("name")), confidence=F.lit(80), policy_status=F.lit("CRITICAL"))
    every = reduce(DataFrame.unionByName, [fd.corroborated(found, ["repo", "path"]), *[x.withColumn("corroboration", F.lit(1).cast("long")) for x in (beside, clients, lent)]])
    order = F.array_position(F.array(*[F.lit(d) for d in DETECTORS]), F.col("detector"))
    of_rule = F.array_position(F.array(*[F.lit(r.slug) for r in catalogue]), F.col("rule"))
    every = every.withColumns({"__order": order, "__rule": of_rule})
    return fd.first_wins(every, "id", ["__order", "__rule", "line", "start", "rule", "match", "severity"]).drop("__order", "__rule")


def judged(found: DataFrame, lists: DataFrame, triage: DataFrame | None = None, baseline: DataFrame | None = None) -> DataFrame:
    """The findings of a scan with policy, scores, status and delta.

    ``lists`` (rule, policy_list) is the policy; ``triage`` (hash, status) sets ``triage_status``;
    against ``baseline`` (id) each is new or unchanged. ``delta_fixed`` gives what is gone.
    """
    rows = fd.with_policy(found, lists).withColumn("file", F.col("path")).withColumn("review_confidence", F.lit(None).cast("int"))
    rows = refreshed(rows).drop("file", "review_confidence")
    if triage is not None:
        rows = rows.join(triage.select(F.col("hash").alias("id"), F.col("status").alias("triage_status")), "id", "left")
    if baseline is not None:
        had = baseline.select("id").distinct().withColumn("__had", F.lit(True))
        rows = rows.join(had, "id", "left").withColumn("delta_status", F.when(F.col("__had"), "unchanged").otherwise("new")).drop("__had")
    return rows


def delta_fixed(found: DataFrame, baseline: DataFrame) -> DataFrame:
    """The baseline's findings (id and more) that the scan has no more."""
    return baseline.join(found.select("id").distinct(), "id", "left_anti")
