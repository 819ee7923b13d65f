"""Facts of repositories: imports, languages, dependencies, calls, models, dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import matches


def safe_datetime(value: Column) -> Column:
    """(epoch, raw): seconds since 1970, 0 for what is no ISO date; for ordering."""
    return F.struct(F.coalesce(F.unix_seconds(F.try_to_timestamp(value)), F.lit(0)).alias("epoch"), F.coalesce(value, F.lit("")).alias("raw"))


def record_datetime(started: Column, completed: Column, scan_id: Column) -> Column:
    """When a scan was: its start, else its end, else the digits of its id, in UTC."""
    digits = F.regexp_extract(scan_id, r"(\d{8})[_T-]?(\d{6})", 1)
    clock = F.regexp_extract(scan_id, r"(\d{8})[_T-]?(\d{6})", 2)
    return F.coalesce(F.try_to_timestamp(started), F.try_to_timestamp(completed), F.try_to_timestamp(F.nullif(F.concat(digits, clock), F.lit("")), F.lit("yyyyMMddHHmmss")))


def repo_token(value: Column) -> Column:
    """The last path segment in lower case, with ``-`` for ``_`` and ``.``."""
    return F.translate(F.lower(F.element_at(F.split(F.regexp_replace(value, r"/+$", ""), "/"), -1)), "_.", "--")


def log_line(at: Column, message: Column, zone: str = "UTC") -> Column:
    return F.concat(F.lit("["), F.date_format(F.from_utc_timestamp(at, zone), "HH:mm:ss"), F.lit("] "), message)


def model_billions(name: Column) -> Column:
    """Size in a model's name (7b, 350m) in billions of parameters; null if none."""
    number = F.regexp_extract(name, r"(?i)(?:^|[^0-9a-z.])(\d+(?:\.\d+)?)([bm])(?:$|[^a-z])", 1)
    unit = F.lower(F.regexp_extract(name, r"(?i)(?:^|[^0-9a-z.])(\d+(?:\.\d+)?)([bm])(?:$|[^a-z])", 2))
    value = F.nullif(number, F.lit("")).cast("double")
    return F.when(unit == "m", value / 1000.0).otherwise(value)


def request_timeout(model: Column, billions: Column, thinking: str = r"(?i)(?:^|[-/:])(?:r1|o[134]|qwq|think\w*|reason\w*)(?:$|[-/:])", tiers=(180, 360, 600), large: float = 14.0) -> Column:
    """Seconds to wait for a model: most for those that reason, more for large ones."""
    return F.when(model.rlike(thinking), tiers[2]).when(billions >= large, tiers[1]).otherwise(tiers[0])


def dependency_scope(name: Column, prefixes: tuple[str, ...] = (), suffixes: tuple[str, ...] = ()) -> Column:
    """internal by the given prefixes and suffixes, else external."""
    inside = F.lit(False)
    for p in prefixes:
        inside = inside | F.lower(name).startswith(p.lower())
    for p in suffixes:
        inside = inside | F.lower(name).endswith(p.lower())
    return F.when(inside, "internal").otherwise("external")


def markers(files: DataFrame, probes: dict[str, str], by: str = "repo") -> DataFrame:
    """repo, marker, files: the probes (name to literal, case is ignored) that files hold."""
    held = F.array_compact(F.array(*[F.when(F.contains(F.lower("content"), F.lit(text.lower())), F.lit(name)) for name, text in probes.items()]))
    return files.select(by, F.explode(held).alias("marker")).groupBy(by, "marker").agg(F.count(F.lit(1)).alias("files"))


#: Names that mark no module.
GENERIC_MODULES = (
    "app main index init utils util common helper helpers config settings model models service services controller controllers handler handlers "
    "route routes page pages view views test tests spec specs readme setup build dist"
).split()


def module_markers(paths: DataFrame, generic=GENERIC_MODULES, least: int = 4, most: int = 16, code: str = r"\.(py|js|ts|jsx|tsx|java|kt|go|rb|cs|php|rs|scala|swift|c|cc|cpp|h)$") -> DataFrame:
    """repo, marker, n: the commonest names of folders and files, without suffix, in the paths of
    each repository's code (repo, path), ``most`` of them.

    A name is in lower case with ``-`` for all but letters and digits; names shorter than ``least``
    and generic ones are none. Ties go to the name that comes first in the sorted paths.
    """
    clean = F.regexp_replace(F.replace("path", F.lit("\\"), F.lit("/")), "/{2,}", "/")
    parts = F.filter(F.split(F.regexp_replace(clean, r"(?<=[^/])\.[^./]*$", ""), "/"), lambda p: p != "")
    tokens = F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(F.lower(p), "[^a-z0-9]+", "-"), "^-+|-+$", ""))
    rows = paths.filter(F.lower("path").rlike(code)).select("repo", "path", F.posexplode(tokens).alias("at", "marker"))
    kept = rows.filter((F.length("marker") >= least) & ~F.col("marker").isin(*generic))
    counted = kept.groupBy("repo", "marker").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("path", "at")).alias("first"))
    order = W.partitionBy("repo").orderBy(F.desc("n"), "first")
    return counted.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= most).select("repo", "marker", "n")


#: Language by file name or suffix, the first that fits.
LANGUAGES = (
    ("Dockerfile", r"(^|/)Dockerfile[^/]*$"), ("Makefile", r"(^|/)Makefile$"), ("Notebook", r"\.ipynb$"), ("Python", r"\.pyi?$"), ("TypeScript", r"\.tsx?$"), ("JavaScript", r"\.(js|jsx|mjs|cjs)$"),
    ("Java", r"\.java$"), ("Kotlin", r"\.kts?$"), ("Scala", r"\.scala$"), ("Go", r"\.go$"), ("Rust", r"\.rs$"), ("C#", r"\.cs$"), ("C++", r"\.(cc|cpp|cxx|hpp)$"), ("C", r"\.[ch]$"), ("Ruby", r"\.rb$"), ("PHP", r"\.php$"),
    ("Shell", r"\.(sh|bash|zsh)$"), ("SQL", r"\.sql$"), ("Terraform", r"\.tf(vars)?$"), ("YAML", r"\.ya?ml$"), ("TOML", r"\.toml$"), ("JSON", r"\.json$"), ("Markdown", r"\.mdx?$"),
    ("Swift", r"\.swift$"), ("HCL", r"\.hcl$"), ("Env", r"(^|/)\.env[^/]*$|\.env$"), ("reStructuredText", r"\.rst$"),
)


#: The order in which languages are told, code before settings and texts.
LANGUAGE_ORDER = (
    "Python", "JavaScript", "TypeScript", "Java", "Go", "C#", "C++", "Rust", "Kotlin", "Ruby", "PHP", "Scala", "Swift", "Shell", "Notebook",
    "YAML", "JSON", "TOML", "Env", "Terraform", "HCL", "Dockerfile", "SQL", "Markdown", "reStructuredText",
)


def languages(files: DataFrame, by: list[str], path: str = "path") -> DataFrame:
    """``by``, languages: the languages of each group's files in ``LANGUAGE_ORDER``, others last by name."""
    found = files.select(*by, language(F.col(path)).alias("l")).filter("l <> 'Other'").distinct()
    place = F.array_position(F.array(*[F.lit(x) for x in LANGUAGE_ORDER]), F.col("l"))
    rank = F.struct(F.when(place > 0, place).otherwise(len(LANGUAGE_ORDER) + 1).alias("p"), "l")
    return found.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(rank)), lambda x: x["l"]).alias("languages"))


def language(path: Column) -> Column:
    out = F.lit("Other")
    for name, pattern in reversed(LANGUAGES):
        out = F.when(path.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def module_paths(module: Column) -> Column:
    """The files that a dotted module may be."""
    path = F.replace(module, F.lit("."), F.lit("/"))
    return F.array(F.concat(path, F.lit(".py")), F.concat(path, F.lit("/__init__.py")))


def resolve_relative(path: Column, target: Column) -> Column:
    """``target`` (./x, ../y/z) seen from the file ``path``, dots collapsed."""
    folder = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    parts = F.concat(folder, F.split(target, "/"))
    empty = F.array().cast("array<string>")
    step = lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(p.isin(".", ""), acc).otherwise(F.array_append(acc, p))
    return F.array_join(F.aggregate(parts, empty, step), "/")


def import_edges(files: DataFrame) -> DataFrame:
    """repo, src, dst: files of a repository that import each other. Python modules
    meet the paths that end in theirs, JavaScript ones the resolved path with each
    usual ending; where several files fit, the first by path counts."""
    every = files.select("repo", "path")
    py = matches(files.filter(F.col("path").endswith(".py")), ["repo", "path"], "content", r"(?m)^[ \t]*(?:from[ \t]+[\w.]+[ \t]+import|import[ \t]+[\w.]+)")
    py = py.select("repo", "path", F.regexp_extract("match", r"(?:from|import)[ \t]+([\w.]+)", 1).alias("module")).filter(~F.col("module").startswith("."))
    py = py.select("repo", F.col("path").alias("src"), F.explode(module_paths(F.col("module"))).alias("tail")).distinct()
    parts = F.split("path", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    index = every.filter(F.col("path").endswith(".py")).select("repo", "path", F.explode(tails).alias("tail")).groupBy("repo", "tail").agg(F.min("path").alias("dst"))
    js = matches(files.filter(F.col("path").rlike(r"\.(js|jsx|ts|tsx|mjs)$")), ["repo", "path"], "content", r"(?:from[ \t]+|require\(|import\(|import[ \t]+)[\"']\.{1,2}/[^\"'\n]+[\"']")
    js = js.select("repo", F.col("path").alias("src"), resolve_relative(F.col("path"), F.regexp_extract("match", r"[\"'](\.{1,2}/[^\"']+)[\"']", 1)).alias("at"))
    endings = F.array(*[F.lit(e) for e in ("", ".js", ".ts", ".jsx", ".tsx", "/index.js", "/index.ts")])
    js = js.select("repo", "src", F.posexplode(F.transform(endings, lambda e: F.concat("at", e))).alias("n", "path")).join(every, ["repo", "path"])
    js = js.groupBy("repo", "src", F.regexp_replace("path", r"(/index)?\.[jt]sx?$", "").alias("at")).agg(F.min_by("path", "n").alias("dst"))
    both = py.join(index, ["repo", "tail"]).select("repo", "src", "dst").unionByName(js.select("repo", "src", "dst"))
    return both.filter("src <> dst").distinct()


def service_calls(files: DataFrame, most: int = 8) -> DataFrame:
    """repo, example: the first ``most`` hosts that the code of a repository names by
    URL, as ``path -> host``, in order of path and place."""
    found = matches(files, ["repo", "path"], "content", r"https?://[A-Za-z0-9.-]+")
    host = F.lower(F.regexp_extract("match", r"://([A-Za-z0-9.-]+)", 1))
    first = found.groupBy("repo", "path", host.alias("host")).agg(F.min("start").alias("start"))
    rank = W.partitionBy("repo").orderBy("path", "start", "host")
    first = first.withColumn("n", F.row_number().over(rank)).filter(F.col("n") <= most)
    return first.select("repo", "n", F.concat("path", F.lit(" -> "), "host").alias("example"))


DB_ACCESS = r"create_engine\(|psycopg2?\.connect\(|sqlite3\.connect\(|pymongo\.MongoClient\(|cursor\(\)\.execute\(|session\.query\("
DB_PLACES = r"(^|/)(db|database|dal|repository|repositories|models?|migrations?|persistence)(/|\.|$)"
UI_PLACES = r"(^|/)(ui|views?|templates?|components?|pages|frontend|web)(/|$)"


def layer_violations(files: DataFrame, access: str = DB_ACCESS, places: str = DB_PLACES, ui: str = UI_PLACES, most: int = 8) -> DataFrame:
    """repo, kind, path: code that opens a database outside database modules, or in
    user-interface ones; the first ``most`` paths of each kind."""
    path = F.lower("path")
    kinds = F.array_compact(F.array(F.when(~path.rlike(places), "outside_db_module"), F.when(path.rlike(ui), "in_ui_module")))
    rows = files.filter(F.col("content").rlike(access)).select("repo", "path", F.explode(kinds).alias("kind")).distinct()
    return rows.withColumn("__n", F.row_number().over(W.partitionBy("repo", "kind").orderBy("path"))).filter(F.col("__n") <= most).select("repo", "kind", "path")


#: Frameworks that need a newer runtime than the one found: framework, runtime, least major version.
NEEDS = (("django", "python", 3.8), ("fastapi", "python", 3.8), ("next", "node", 18.0), ("spring-boot", "java", 17.0), ("react", "node", 16.0))


def old_runtime_frameworks(dependencies: DataFrame, runtimes: DataFrame, needs=NEEDS) -> DataFrame:
    """repo, label: declared frameworks (repo, name) on runtimes (repo, runtime,
    version double) older than they need."""
    table = dependencies.sparkSession.createDataFrame(list(needs), "name string, runtime string, least double")  # a row a framework
    hit = dependencies.join(F.broadcast(table), "name").join(runtimes, ["repo", "runtime"]).filter("version < least")
    return hit.select("repo", F.concat_ws(" ", "name", F.lit("on"), "runtime", F.format_string("%.1f", "version")).alias("label")).distinct()


def newest_baseline(files: DataFrame, project: str, repo: str) -> DataFrame:
    """The newest of the baseline files (name) of one repository, by the name after
    the exact prefix, so that another repository that begins alike does not match."""
    stem = F.regexp_extract("name", r"^(.*)\.csv$", 1)
    exact = stem.rlike(rf"^\Q{project}_{repo}_\E\d[\d_T-]*$")
    return files.filter(exact).agg(F.max("name").alias("name"))


def rescan_scope(changed: DataFrame | None, files: DataFrame) -> DataFrame:
    """Files of an incremental scan: those changed (repo, path); all of them where no
    comparison could be made (None); none for an empty comparison."""
    return files if changed is None else files.join(changed.select("repo", "path").distinct(), ["repo", "path"], "left_semi")


def history_filter(scans: DataFrame, text: str = "", **equal: str | None) -> DataFrame:
    """Scans whose columns hold the free text and equal the given values."""
    words = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in scans.columns]))
    out = scans.filter(F.contains(words, F.lit(text.strip().lower()))) if text.strip() else scans
    for name, value in equal.items():
        out = out.filter(F.col(name) == value) if value else out
    return out
