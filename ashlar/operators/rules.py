"""A rule catalogue as data, and the detectors that run it over files.

A rule names a slug, category, label, severity and an RE2-safe pattern, with an
optional guard that the file must match and a path class. Slugs and categories are
fixed values: policies, triage and remediation name findings by them. Labels and
patterns are this package's own. Add a rule by adding a row (or pass another table).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.text import distinct_chars, entropy, match_array, matches, minified, path_class, placed, stable_id, strip_comments
from .meet import meet


@dataclass(frozen=True)
class Rule:
    slug: str
    category: str
    label: str
    severity: int
    pattern: str
    guard: str | None = None
    #: True: files that aren't code; False: files that aren't configuration; None: all files.
    config_only: bool | None = False
    entropy: bool = False
    path: str | None = None
    #: Literals in lower case of which a file with a match holds one; the cheap test before the pattern.
    anchors: tuple[str, ...] = ()


def _sdk(slug: str, module: str, category: str, label: str, severity: int, *names: str) -> Rule:
    """A rule for a library: its import in Python or JavaScript, or its names."""
    more = "".join(f"|{n}" for n in names)
    anchors = tuple(re.match(r"[a-z0-9_.]+", n.replace("\\", "").lower())[0].split("_in_")[0] for n in (module, *names))
    return Rule(slug, category, label, severity, rf"(?m)^[ \t]*(?:import|from)[ \t]+{module}\b|require\(['\"]{module}['\"]\)|from[ \t]+['\"]{module}['\"]{more}", anchors=anchors)


API, LOCAL, EMB, RAG, TUNE, ML, SEC, AGENT, GW, INFRA = "External AI API", "Local LLM Runtime", "Embeddings", "RAG/Vector DB", "Fine-tuning/Training", "ML Library", "Security", "Agent Framework", "AI Proxy/Gateway", "Infrastructure AI Config"
RULES = (
    _sdk("openai", "openai", API, "Hosted model calls", 2, r"OpenAI\("), _sdk("anthropic", "anthropic", API, "Hosted model calls", 2, r"Anthropic\("), _sdk("cohere", "cohere", API, "Hosted model calls", 2, r"cohere\.Client"),
    _sdk("google_gemini_vertexai", "google\\.generativeai", API, "Hosted model calls", 2, r"GenerativeModel\("), _sdk("mistral_ai", "mistralai", API, "Hosted model calls", 2, r"MistralClient\("), _sdk("groq", "groq", API, "Hosted model calls", 2, r"Groq\("),
    _sdk("langchain", "langchain", API, "Prompt chains", 2, r"ChatOpenAI\("), _sdk("llama_index", "llama_index", API, "Retrieval pipeline", 2), _sdk("huggingface_hub", "huggingface_hub", API, "Hosted inference", 2, r"InferenceClient\("),
    _sdk("transformers", "transformers", LOCAL, "Model run in process", 3, r"AutoModelForCausalLM"), _sdk("vllm", "vllm", LOCAL, "Self-hosted model server", 3), _sdk("llama_cpp", "llama_cpp", LOCAL, "Model run in process", 3), _sdk("ollama", "ollama", LOCAL, "Model run in process", 3, r"ollama\.(?:chat|generate)"),
    _sdk("sentence_transformers", "sentence_transformers", EMB, "Text to vectors", 3, r"SentenceTransformer\("), Rule("openai_embeddings", EMB, "Text to vectors", 2, r"embeddings\.create\(|text-embedding-[a-z0-9-]+", anchors=("embedding",)),
    _sdk("faiss", "faiss", RAG, "Nearest-neighbour index", 3, r"faiss\.Index\w+"), _sdk("chromadb", "chromadb", RAG, "Vector store", 3), _sdk("qdrant", "qdrant_client", RAG, "Vector store", 3, r"QdrantClient\("), _sdk("weaviate", "weaviate", RAG, "Vector store", 3), _sdk("milvus", "pymilvus", RAG, "Vector store", 3), _sdk("pinecone", "pinecone", RAG, "Vector store", 2), Rule("pgvector", RAG, "Vectors in PostgreSQL", 3, r"(?i)create\s+extension[^;\n]*\bvector\b|pgvector", anchors=("vector",)),
    _sdk("peft_lora", "peft", TUNE, "Adapter training", 2, r"LoraConfig\("), _sdk("trl", "trl", TUNE, "Preference training", 2, r"SFTTrainer\("), _sdk("accelerate", "accelerate", TUNE, "Training on many devices", 3), _sdk("bitsandbytes", "bitsandbytes", TUNE, "Low-bit weights", 3, r"load_in_[48]bit"),
    _sdk("pytorch", "torch", ML, "Neural network library", 4), _sdk("tensorflow", "tensorflow", ML, "Neural network library", 4), _sdk("scikit_learn", "sklearn", ML, "Classical learning library", 4), _sdk("xgboost", "xgboost", ML, "Boosted trees", 4), _sdk("lightgbm", "lightgbm", ML, "Boosted trees", 4),
    _sdk("litellm", "litellm", GW, "Model proxy", 3), _sdk("portkey", "portkey_ai", GW, "Model gateway", 3), _sdk("autogen", "autogen", AGENT, "Cooperating agents", 2), _sdk("crewai", "crewai", AGENT, "Cooperating agents", 2), _sdk("langgraph", "langgraph", AGENT, "Agent state graph", 2, r"StateGraph\("), _sdk("semantic_kernel", "semantic_kernel", AGENT, "Agents with plugins", 2),
    Rule("direct_http_ai", API, "Model endpoint by URL", 2, r"https?://api\.(?:openai|anthropic|cohere|mistral|groq)\.(?:com|ai)", anchors=("://api.",)),
    Rule("hardcoded_credential", SEC, "Credential in source", 1, r"(?i)(?:password|passwd|secret|token|api_?key)[ \t]*[:=][ \t]*[\"'][^\"'\s]{8,}[\"']", entropy=True, anchors=("password", "passwd", "secret", "token", "api_key", "apikey")),
    Rule("plain_credential", SEC, "Unquoted credential", 2, r"(?i)(?:password|passwd|secret|api_?key)=[A-Za-z0-9+/_.-]{8,}", entropy=True, anchors=("password", "passwd", "secret", "api_key", "apikey")),
    Rule("aws_access_key", SEC, "Cloud access key id", 1, r"AKIA[0-9A-Z]{16}", anchors=("akia",)), Rule("google_api_key", SEC, "Google key", 1, r"AIza[0-9A-Za-z_-]{35}", anchors=("aiza",)), Rule("github_token", SEC, "Git host token", 1, r"gh[pousr]_[A-Za-z0-9]{36}", anchors=("gho_", "ghp_", "ghu_", "ghs_", "ghr_")), Rule("slack_token", SEC, "Chat workspace token", 1, r"xox[abprs]-[0-9A-Za-z-]{10,}", anchors=("xox",)), Rule("openai_key_pattern", SEC, "Model provider key", 1, r"sk-[A-Za-z0-9]{32,}", anchors=("sk-",)), Rule("anthropic_key_pattern", SEC, "Model provider key", 1, r"sk-ant-[A-Za-z0-9_-]{20,}", anchors=("sk-ant-",)), Rule("stripe_key", SEC, "Payment key", 1, r"[rs]k_live_[0-9A-Za-z]{20,}", anchors=("k_live_",)),
    Rule("unsafe_code_exec", SEC, "Model or user text is executed", 1, r"\b(?:eval|exec)\([^)\n]*(?:response|output|completion|request|input)|os\.system\(", anchors=("eval(", "exec(", "os.system(")), Rule("unsafe_pickle_model", SEC, "Pickled objects are loaded", 2, r"(?:pickle|joblib|marshal)\.loads?\(", anchors=("pickle.load", "joblib.load", "marshal.load")), Rule("trust_remote_code", SEC, "Remote model code is run", 1, r"trust_remote_code\s*=\s*True", anchors=("trust_remote_code",)), Rule("unsafe_numpy_pickle", SEC, "Pickled arrays are allowed", 2, r"allow_pickle\s*=\s*True", anchors=("allow_pickle",)),
    Rule("sql_injection_direct", SEC, "SQL built from strings", 1, r"(?i)execute\(\s*f[\"']|execute\([^)\n]*(?:%|\+|\.format\()", anchors=("execute(",)), Rule("debug_mode", SEC, "Debug switch is on", 3, r"(?i)\bdebug\s*=\s*True|FLASK_DEBUG\s*=\s*1", anchors=("debug",)), Rule("prompt_injection_risk", SEC, "User text enters a prompt", 2, r"(?i)prompt\s*[+=]+[^\n]*(?:request|user_input|body|form)", guard=r"(?i)openai|anthropic|langchain|llm", anchors=("prompt",)), Rule("jailbreak_pattern", SEC, "Override phrase", 2, r"(?i)ignore (?:all |any )?(?:previous|prior|above) (?:instructions|rules)", anchors=("ignore ",)),
    Rule("logging_risk", SEC, "Prompt or key is logged", 2, r"(?i)(?:print|logger\.\w+)\([^)\n]*(?:prompt|api_key|completion)", anchors=("print(", "logger.")), Rule("markdown_exfil", SEC, "Image link carries data", 2, r"!\[[^\]\n]*\]\(https?://[^)\n]*\?[^)\n]*=\{", anchors=("](http",)),
    Rule("env_file_key", SEC, "Credential in settings", 2, r"(?m)^[ \t]*(?:export[ \t]+)?[A-Z_]*(?:API_KEY|TOKEN|SECRET)[ \t]*[:=][ \t]*\S{8,}", config_only=True, entropy=True, anchors=("api_key", "token", "secret")), Rule("dependency_declaration", API, "Declared model library", 4, r"(?m)^[ \t\"']*(?:openai|anthropic|langchain|transformers|torch)[\"']?[ \t]*(?:[=~<>:]|$)", config_only=True, anchors=("openai", "anthropic", "langchain", "transformers", "torch")), Rule("k8s_model_serving", LOCAL, "Model server image", 3, r"image:[ \t]*\S*(?:ollama|vllm|triton|torchserve)", config_only=True, anchors=("image:",)),
    Rule("email_address", "Personal Data", "Mail address", 3, r"[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+", anchors=("@",)), Rule("card_number", "Personal Data", "Sixteen digits", 2, r"[0-9]{16}"), Rule("licence_line", "License", "Licence statement", 4, r"(?i)licen[cs]ed under|released under", anchors=("licensed under", "licenced under", "released under")),
)
CODE = r"\.(py|ipynb|js|ts|jsx|tsx|java|go|rb|cs|php|rs|scala|c|cc|cpp|h|sh|sql)$"
CONFIG = r"\.(ya?ml|toml|ini|cfg|conf|env|properties|tf|json)$|(^|/)(\.env[^/]*|Dockerfile|requirements[^/]*\.txt)$"
PLACEHOLDER = r"(?i)^(your|example|sample|dummy|changeme|placeholder|xxx|test|none|null|<|\$|%)"
SINK = r"(?i)(?:openai|anthropic|client|llm|chain|model)\.?\w*\.(?:create|invoke|complete|generate|chat|run)\("
SUSPECT = r"(?i)(?:password|passwd|secret|token|api_?key|credential|private_?key)"


def applies(r: Rule, held: str | None = None) -> Column:
    """A rule fits a file by its class and guards: config rules skip code files,
    others skip config files (rules for all files skip none), files that are neither take all. Guards are looked for in
    the content, or among those that the column ``held`` says hold."""
    code, config = F.lower("path").rlike(CODE), F.lower("path").rlike(CONFIG)
    fits = F.lit(True) if r.config_only is None else (~code | config) if r.config_only else (~config | code)
    if r.anchors:
        anchored = [F.contains(F.col("lowered"), F.lit(a)) for a in r.anchors]
        fits = reduce(or_, anchored) & fits
    if r.guard:
        fits = fits & (F.array_contains(held, r.guard) if held else F.col("content").rlike(r.guard))
    return fits & F.lower("path").rlike(r.path) if r.path else fits


VALUE = r"[:=][ \t]*[\"']?([^\"'\s]+)"


def literal_value(match: Column) -> Column:
    return F.regexp_extract(match, VALUE, 1)


def low_entropy(match: Column, least: float = 3.0) -> Column:
    """No value, a placeholder or a value of few bits: no credential."""
    value = literal_value(match)
    return (value == "") | value.rlike(PLACEHOLDER) | (entropy(value) < least)


#: Comment family by suffix; files of other suffixes are read as they are.
FAMILIES = {"python": r"\.py$", "c": r"\.(js|ts|jsx|tsx|java|kt|go|cs|php|rs|scala|c|cc|cpp|h)$", "hash": r"\.(sh|rb)$", "sql": r"\.sql$"}
#: Rules whose match counts for nothing where the lines around it have the pattern: fixed argument lists, parameterised statements, exception handlers.
NOISE = {"unsafe_code_exec": r"subprocess\.(?:run|Popen|check_output)\(\s*\[", "sql_injection_direct": r"execute\([^)\n]*[\"']\s*,\s*[\[(]", "logging_risk": r"(?m)^\s*except\b"}


def code_text(path: Column, content: Column) -> Column:
    """The content with comments blanked by the file's language; offsets stay."""
    out = content
    for family, suffix in FAMILIES.items():
        out = F.when(F.lower(path).rlike(suffix), strip_comments(content, family)).otherwise(out)
    return out


def around(lines: Column, line: Column, before: int, after: int, width: int) -> Column:
    first = F.greatest(line - before, F.lit(1))
    return F.array_join(F.transform(F.slice(lines, first, line + after - first + 1), lambda x: F.substring(x, 1, width)), "\n")


def detect(
    files: DataFrame, rules=RULES, bump: bool = True, stripped: bool = True, noise: dict[str, str] = NOISE, exclude: tuple[tuple[str, str], ...] = (), allow: tuple[str, ...] = (), deny: tuple[str, ...] = (),
    held: str | None = None,
) -> DataFrame:
    """Findings of every applicable rule in ``files`` (repo, path, content).

    Rules and guards see the text without comments (``stripped``), snippets the
    raw one. ``noise`` maps a slug to a pattern over the lines from 8 before to 3
    after, in which it counts for nothing; ``exclude`` has (path pattern, slug) that
    never count; ``allow`` and ``deny`` are patterns over the match that set the
    policy status; ``held`` is a column of the guards that hold, where a file is a part
    of what guards are looked for in. All rules are one projection over a file's text and one explode:
    files are read once, no text is shuffled, and a match row carries its snippet
    instead of the file. Rows: repo, path, ordinal, rule, category, capability,
    severity, context, start, line, match, snippet, id, confidence, policy_status.
    """
    found = []
    for i, r in enumerate(rules):
        fits = applies(r, held)
        for pattern, slug in exclude:
            fits = fits & ~F.col("path").rlike(pattern) if slug == r.slug else fits
        parts = F.struct(F.lit(i).alias("ordinal"), F.regexp_extract_all("content", F.lit(r.pattern), F.lit(0)).alias("hits"), F.split("content", r.pattern, -1).alias("gaps"))
        found.append(F.when(fits & F.col("content").rlike(r.pattern), parts))
    secret = [i for i, r in enumerate(rules) if r.entropy]

    def of_rule(r: Column) -> Column:
        return F.transform(placed(r["hits"], r["gaps"]), lambda m: F.struct(m["start"].alias("start"), m["line"].alias("line"), m["match"].alias("match"), r["ordinal"].alias("ordinal")))

    hits = F.flatten(F.transform(F.array_compact(F.array(*found)), of_rule))
    if secret:
        hits = F.filter(hits, lambda m: ~m["ordinal"].isin(*secret) | ~low_entropy(m["match"]))
    files = files.withColumn("raw", F.col("content"))
    if stripped:
        files = files.withColumn("content", code_text(F.col("path"), F.col("content")))
    files = files.withColumn("lowered", F.lower("content"))
    quiet = {i: noise[r.slug] for i, r in enumerate(rules) if r.slug in noise}

    def shown(text: Column) -> Column:
        def one(m: Column) -> Column:
            return F.struct(m["start"].alias("start"), m["line"].alias("line"), m["match"].alias("match"), m["ordinal"].alias("ordinal"), around(text["raw"], m["line"], 2, 2, 200).alias("snippet"))

        hits = text["hits"]
        for i, pattern in quiet.items():
            hits = F.filter(hits, (lambda i, pattern: lambda m: (m["ordinal"] != i) | ~around(text["code"], m["line"], 8, 3, 1000).rlike(pattern))(i, pattern))
        return F.transform(hits, one)

    text = F.struct(F.split("raw", "\n", -1).alias("raw"), F.split("content", "\n", -1).alias("code"), hits.alias("hits"))
    out = files.select("repo", "path", F.explode(F.transform(F.array(text), shown)[0]).alias("m")).select("repo", "path", "m.*")
    of = lambda name: F.element_at(F.array(*[F.lit(getattr(r, name)) for r in rules]), F.col("ordinal") + 1)
    out = out.withColumns({"rule": of("slug"), "category": of("category"), "capability": of("label"), "base": of("severity")})
    context = path_class(F.col("path"))
    severity = scoring.bumped(F.col("base"), scoring.context_bump(F.col("context"))) if bump else F.col("base")
    signals = {
        "security": F.col("category") == SEC, "direct_assignment": F.col("match").rlike(r"\w+\s*[=:]\s*\S"), "call_site": F.col("match").rlike(r"\w\("),
        "long_match": F.length("match") >= 20, "very_short": F.length("match") <= 6, "test": F.col("context") == "test", "docs": F.col("context") == "docs",
    }
    out = out.withColumn("context", context).withColumn("severity", severity)
    return out.select(
        "repo", "path", "ordinal", "rule", "category", "capability", "severity", "context", "start", "line", "match", "snippet",
        stable_id(F.col("repo"), F.col("path"), F.col("match")).alias("id"), scoring.confidence(signals).alias("confidence"),
        scoring.allow_deny(F.col("match"), F.col("category") == SEC, list(allow), list(deny)).alias("policy_status"),
    )


def notebook_findings(cells: DataFrame, rules=RULES, least: float = 4.5) -> DataFrame:
    """Findings in notebook cells (repo, path, cell, content, outputs): rules for
    code over the cells, comments stripped as Python's, and rules of the category
    Security over the outputs. The path names the cell; findings of outputs have a
    confidence of 90."""
    code = tuple(r for r in rules if not r.config_only)
    named = cells.withColumn("path", F.concat("path", F.lit("::cell["), F.col("cell").cast("string"), F.lit("]")))
    strip = named.select("repo", "path", strip_comments(F.col("content"), "python").alias("content"))
    found = detect(strip, code, stripped=False).withColumn("in_output", F.lit(False))
    shown = named.select("repo", "path", F.array_join("outputs", "\n").alias("content")).filter("content <> ''")
    secrets = detect(shown, tuple(r for r in code if r.category == SEC), stripped=False).withColumn("confidence", F.lit(90)).withColumn("in_output", F.lit(True))
    return found.unionByName(secrets)


BUNDLE_KEYS = r"sk-[A-Za-z0-9_-]{20,}|AKIA[0-9A-Z]{16}|AIza[0-9A-Za-z_-]{35}"
BUNDLE_ENDPOINTS = r"https?://api\.(?:openai|anthropic|cohere|mistral|groq)\.(?:com|ai)"


def bundle_findings(files: DataFrame, keys: str = BUNDLE_KEYS, endpoints: str = BUNDLE_ENDPOINTS, around: int = 150) -> DataFrame:
    """Keys and model endpoints in minified bundles: one alternation over the text,
    and the characters around each match. Keys are severity 1, endpoints 2, two
    more in tests (4 at most)."""
    bundles = files.filter(minified(F.col("path"), F.col("content")))
    gaps = F.transform(match_array(F.col("content"), f"{keys}|{endpoints}"), lambda m: F.struct(m["start"].alias("start"), m["match"].alias("match"), F.substring(F.col("content"), F.greatest(m["start"] - around + 1, F.lit(1)), F.length(m["match"]) + 2 * around).alias("context")))
    rows = bundles.select("repo", "path", F.explode(gaps).alias("m")).select("repo", "path", "m.*")
    base = F.when(F.col("match").rlike(f"^(?:{keys})"), 1).otherwise(2)
    test = path_class(F.col("path")) == "test"
    return rows.withColumn("severity", F.least(base + F.when(test, 2).otherwise(0), F.lit(4))).withColumn("confidence", F.lit(80))


def deleted_file_findings(deleted: DataFrame, rules=RULES) -> DataFrame:
    """Findings in the last text of deleted files (repo, path, commit, content,
    label): severities as in the catalogue, security ones critical."""
    found = detect(deleted, rules, bump=False).join(deleted.select("repo", "path", "commit", "label").distinct(), ["repo", "path"])
    secure = F.col("category") == SEC
    status = F.when(secure, "CRITICAL").otherwise(F.col("policy_status"))
    return found.withColumn("severity", F.when(secure, 1).otherwise(F.col("severity"))).withColumn("policy_status", status).withColumn("context", F.lit("deleted_file"))


def high_entropy(files: DataFrame, least: float = 4.5, around: int = 200, low: int = 20, high: int = 120) -> DataFrame:
    """Quoted literals of many bits with a suspect name nearby, one a line. Literals
    are judged within the row: what leaves it is kept."""
    text = F.col("content")
    value = lambda m: F.substring(m["match"], F.lit(2), F.length(m["match"]) - 2)
    near = lambda m: F.substring(text, F.greatest(m["start"] - around + 1, F.lit(1)), F.length(m["match"]) + 2 * around)
    kept = F.filter(match_array(text, rf"[\"'][^\"'\s]{{{low},{high}}}[\"']"), lambda m: (distinct_chars(value(m)) >= 6) & (entropy(value(m)) >= least) & near(m).rlike(SUSPECT))
    found = files.filter(text.rlike(SUSPECT)).select("repo", "path", F.explode(F.transform(kept, lambda m: F.struct(m["line"].alias("line"), m["start"].alias("start"), value(m).alias("value")))).alias("m"))
    return found.groupBy("repo", "path", "m.line").agg(F.min(F.struct("m.start", "m.value")).alias("v")).select("repo", "path", "line", "v.start", "v.value")


CONSTRUCTORS = {"openai": r"(?:Async|Azure)?OpenAI", "anthropic": r"(?:Async)?Anthropic", "cohere": r"cohere\.Client", "mistral": r"Mistral(?:Client)?", "groq": r"Groq", "langchain": r"Chat(?:OpenAI|Anthropic)"}


def cross_file_credentials(files: DataFrame) -> DataFrame:
    """Upper-case credential constants of one file imported by name in another."""
    made = matches(files, ["repo", "path"], "content", r"(?m)^[A-Z][A-Z0-9_]*(?:KEY|TOKEN|SECRET|PASSWORD)[A-Z0-9_]*[ \t]*=[ \t]*[\"'][^\"'\n]+[\"']")
    made = made.select("repo", F.col("path").alias("source"), F.regexp_extract("match", r"^(\w+)", 1).alias("name")).distinct()
    used = imported_names(files)
    return used.join(made, ["repo", "name"]).filter("path <> source")


def cross_file_clients(files: DataFrame, sink: str = SINK) -> DataFrame:
    """Model clients that one file makes and another imports by name and calls:
    repo, path, line, name, provider, source."""
    key = ["repo", "path"]
    provider = F.lit(None).cast("string")
    for name, ctor in reversed(CONSTRUCTORS.items()):
        provider = F.when(F.col("match").rlike(rf"=\s*(?:{ctor})\("), F.lit(name)).otherwise(provider)
    made = matches(files, key, "content", rf"(?m)^[A-Za-z_]\w*[ \t]*=[ \t]*(?:{'|'.join(CONSTRUCTORS.values())})\(")
    made = made.select("repo", F.col("path").alias("source"), F.regexp_extract("match", r"^(\w+)", 1).alias("name"), provider.alias("provider"), "start")
    made = made.groupBy("repo", "source", "name").agg(F.max_by("provider", "start").alias("provider"))
    return meet(imported_names(files.filter(F.col("content").rlike(sink))), made, ["repo", "name"]).filter("path <> source")


def imported_names(files: DataFrame) -> DataFrame:
    """repo, path, line, name of every ``from x import name``."""
    used = matches(files, ["repo", "path"], "content", r"(?m)^[ \t]*from[ \t]+[\w.]+[ \t]+import[ \t]+[^\n]+")
    used = used.select("repo", "path", "line", F.explode(F.split(F.regexp_extract("match", r"import[ \t]+\(?([^\n)]*)", 1), r"\s*,\s*")).alias("name"))
    return used.withColumn("name", F.regexp_extract("name", r"^(\w+)", 1))


def ignored(paths: DataFrame, rules: list[str]) -> DataFrame:
    """gitignore rules over ``paths`` (path): the last that matches wins, ``!``
    negates, ``/`` anchors, a trailing ``/`` means folders. Adds ``ignored``."""
    state = F.lit(False)
    for line in rules:
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        negate, line = line.startswith("!"), line.lstrip("!")
        folder, body = line.endswith("/"), line.strip("/")
        out = ""
        i = 0
        while i < len(body):
            if body.startswith("**/", i):
                out, i = out + "(?:.*/)?", i + 3
            elif body.startswith("**", i):
                out, i = out + ".*", i + 2
            elif body[i] == "*":
                out, i = out + "[^/]*", i + 1
            elif body[i] == "?":
                out, i = out + "[^/]", i + 1
            else:
                out, i = out + ("\\" + body[i] if body[i] in ".+()[]{}^$|\\" else body[i]), i + 1
        top = "^" if line.startswith("/") or "/" in body else "(?:^|.*/)"
        state = F.when(F.col("path").rlike(f"(?i){top}{out}{'/' if folder else '(?:/|$)'}"), F.lit(not negate)).otherwise(state)
    return paths.withColumn("ignored", state)
