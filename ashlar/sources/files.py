"""Files, notebooks, baselines and deleted files as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Folders that hold no sources, file names that are not read, and suffixes that are.
SKIP_DIRS = (".git", ".hg", ".svn", ".idea", ".vscode", ".tox", ".venv", "venv", "env", "node_modules", "__pycache__", ".mypy_cache", ".pytest_cache", "build", "dist", "target", "vendor")
SKIP_FILES = ("package-lock.json", "yarn.lock", "poetry.lock", "Pipfile.lock")
SUFFIXES = (".py", ".ipynb", ".js", ".ts", ".jsx", ".tsx", ".java", ".kt", ".go", ".rb", ".cs", ".php", ".rs", ".scala", ".c", ".cc", ".cpp", ".h", ".sh", ".sql", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".conf", ".env", ".properties", ".tf", ".json", ".md", ".txt", ".gradle", ".kts")
NAMES = ("Dockerfile", "Makefile", "Jenkinsfile", "CODEOWNERS", "go.mod", "pom.xml")


def scannable(path: Column, skip_dirs=SKIP_DIRS, skip_files=SKIP_FILES, suffixes=SUFFIXES, names=NAMES) -> Column:
    """Kept by folder, name and suffix. Only folders are tested against the
    skipped ones, so a file that is named like one is read."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    skipped = F.exists(folders, lambda p: p.isin(*skip_dirs) | p.endswith(".egg-info"))
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    return ~skipped & ~name.isin(*skip_files) & (name.isin(*names) | suffix.isin(*suffixes))


def read_files(spark: SparkSession, root: str, repo: Column | None = None, max_bytes: int | None = None) -> DataFrame:
    """repo, path, size, content of the files below ``root``; the first folder is
    the repository unless ``repo`` is given. Bytes that are no UTF-8 are replaced."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = rows.select(F.regexp_replace("path", r"^[a-z]+:/+", "/").alias("full"), F.col("length").alias("size"), "content")
    top = root.split("://")[-1].rstrip("/")
    rel = F.substring(F.col("full"), F.instr("full", top + "/") + len(top) + 1, F.length("full"))
    rows = base.withColumn("rel", rel)
    rows = rows.withColumn("repo", F.regexp_extract("rel", r"^([^/]+)/", 1) if repo is None else repo)
    rows = rows.withColumn("path", F.regexp_replace("rel", r"^[^/]+/", "") if repo is None else F.col("rel")).filter(scannable(F.col("path")))
    if max_bytes is not None:
        rows = rows.filter(F.col("size") <= max_bytes)
    return rows.select("repo", "path", "size", F.expr("cast(content as string)").alias("content"))


def scope(files: DataFrame, include: DataFrame | None = None, exclude: list[str] = ()) -> DataFrame:
    """``include`` (path): only those paths; null: all, empty: none. ``exclude``:
    paths or folders."""
    if include is not None:
        files = files.join(include.select("path").distinct(), "path", "left_semi")
    for p in exclude:
        files = files.filter((F.col("path") != p) & ~F.col("path").startswith(p.rstrip("/") + "/"))
    return files


_CELL = "struct<cell_type:string,source:string,outputs:array<struct<text:string>>>"


def notebook_cells(files: DataFrame) -> DataFrame:
    """repo, path, cell (1-based over all cells), content, outputs of the code and
    raw cells of notebooks; sources may be strings or lists. Invalid JSON: no rows."""
    book = F.from_json("content", f"struct<cells:array<{_CELL}>>")
    rows = files.filter(F.col("path").endswith(".ipynb")).select("repo", "path", F.posexplode(book["cells"]).alias("i", "c"))

    def text(c: Column) -> Column:  # a list arrives as its JSON
        listed = F.from_json(c, "array<string>")
        return F.coalesce(F.array_join(listed, ""), c, F.lit(""))

    rows = rows.filter(F.col("c.cell_type").isin("code", "raw"))
    outputs = F.transform(F.coalesce(F.col("c.outputs"), F.array().cast("array<struct<text:string>>")), lambda o: text(o["text"]))
    return rows.select("repo", "path", (F.col("i") + 1).alias("cell"), text(F.col("c.source")).alias("content"), outputs.alias("outputs"))


def read_baseline(spark: SparkSession, path: str, key: str = "finding_id") -> DataFrame:
    """A baseline CSV: fields trimmed, rows without key dropped, the last row of a key wins."""
    rows = spark.read.option("header", "true").option("multiLine", "true").csv(path)
    rows = rows.select(*[F.trim(F.col(c)).alias(c) for c in rows.columns], F.monotonically_increasing_id().alias("__n"))
    rows = rows.filter(F.coalesce(F.col(key), F.lit("")) != "")
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (key, "__n")]), "__n").alias("r")).select(key, "r.*")


def deleted_files(log: DataFrame, most: int | None = 200, max_chars: int | None = 500_000) -> DataFrame:
    """Newest deletion of each path in a history log (repo, position, commit, path,
    content): the first ``most`` entries of a repository count, as a history scan reads
    them, and texts of up to ``max_chars``; None for all."""
    kept = log.filter(scannable(F.col("path"))).select("repo", "position", "commit", "path")
    if most is not None:
        newest = W.partitionBy("repo").orderBy("position", "commit", "path")  # tasks keep the first rows before they are sent
        kept = kept.withColumn("__n", F.row_number().over(newest)).filter(F.col("__n") <= most)
    kept = kept.groupBy("repo", "path").agg(F.min(F.struct("position", "commit")).alias("first"))
    text = log.select("repo", "commit", "path", "content").filter(F.length("content") > 0)
    text = text if max_chars is None else text.filter(F.length("content") <= max_chars)
    return kept.select("repo", "path", F.col("first.commit").alias("commit")).join(text, ["repo", "commit", "path"]).withColumn("label", F.concat(F.lit("[DELETED]"), "path"))
