"""Snapshots of file trees, what changed between two, and the files that a scan needs.

A snapshot is a manifest: one row a file with the digest of its content. Scans of a
part compare manifests instead of asking a version system; where no manifest to compare
with is left, a repository is scanned as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import Folder

MANIFEST = "repo string, path string, digest string, size long"
#: What facts of a repository are read from.
FACT_SKIP_DIRS = (".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", "target", "coverage")
FACT_SUFFIXES = (".json", ".toml", ".txt", ".py", ".xml", ".gradle", ".kts", ".yaml", ".yml", ".mod", ".csproj", ".props", ".md", ".js", ".ts", ".tsx", ".jsx", ".go", ".java", ".proto", ".tf")
FACT_NAMES = ("dockerfile", "jenkinsfile", "security.md", "license", "license.md", "readme", "readme.md", "chart.yaml", "bitbucket-pipelines.yml", "azure-pipelines.yml", ".nvmrc", "runtime.txt", "codeowners")
FACT_BYTES = 250_000


def in_tree(path: Column) -> Column:
    """Not below, or named as, a folder that facts skip."""
    return ~F.exists(F.split(path, "/"), lambda p: p.isin(*FACT_SKIP_DIRS))


def tells_facts(path: Column) -> Column:
    """Files whose content facts are read from, by suffix, name or as a workflow."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    suffix = F.regexp_extract(name, r"[^.](\.[^.]+)$", 1)
    return suffix.isin(*FACT_SUFFIXES) | name.isin(*FACT_NAMES) | F.lower(path).contains(".github/workflows/")


def facts_files(listed: DataFrame, max_bytes: int | None = FACT_BYTES) -> DataFrame:
    """repo, path, size, content of all files that are not skipped: the names of all, the
    content of those that tell facts and are not too large, null for the others."""
    small = F.lit(True) if max_bytes is None else F.col("size") <= max_bytes
    return listed.filter(in_tree(F.col("path"))).select("repo", "path", "size", F.when(tells_facts(F.col("path")) & small, F.col("content")).alias("content"))


def read_facts_files(spark: SparkSession, root: str, max_bytes: int | None = FACT_BYTES) -> DataFrame:
    """``facts_files`` of the trees below ``root``, whose first folders are repositories.

    Names come from the listing alone; contents from a second read that the size is
    pushed down to, so that large files are never opened. Spark's file sources leave out
    names that begin with a dot or underscore; workflow folders are named to it, other
    such files are not seen.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([root, *Folder(spark, root).glob("*/.github/workflows")])
    top = root.split("://")[-1].rstrip("/")
    rel = F.substring(F.col("path"), F.instr("path", top + "/") + len(top) + 1, F.length("path"))
    repo, path = F.regexp_extract("rel", r"^([^/]+)/", 1).alias("repo"), F.regexp_replace("rel", r"^[^/]+/", "").alias("path")
    names = files.select(rel.alias("rel"), F.col("length").alias("size")).select(repo, path, "size").filter(in_tree(F.col("path")))
    small = files if max_bytes is None else files.filter(F.col("length") <= max_bytes)
    texts = small.select(rel.alias("rel"), F.expr("cast(content as string)").alias("content")).select(repo, path, "content").filter(in_tree(F.col("path")) & tells_facts(F.col("path")))
    return names.join(texts, ["repo", "path"], "left")


def manifest(files: DataFrame) -> DataFrame:
    """The manifest of files (repo, path, size, content); a content that was not read has no digest."""
    return files.select("repo", "path", F.sha2(F.col("content"), 256).alias("digest"), F.col("size").cast("long").alias("size"))


def changes(old: DataFrame, new: DataFrame, by: list[str] = ()) -> DataFrame:
    """repo, path, change, was: what ``new`` adds to, changes in and lacks of ``old``.

    A file that is gone and one that appeared in the same repository with the same
    digest are one renamed file, first with first by path. Files without digest differ by
    size. ``by`` names more key columns that both have, as of many snapshots at once.
    """
    key = [*by, "repo", "path"]
    a = old.select(*key, F.col("digest").alias("d0"), F.col("size").alias("s0"), F.lit(True).alias("had"))
    b = new.select(*key, F.col("digest").alias("d1"), F.col("size").alias("s1"), F.lit(True).alias("has"))
    both = a.join(b, key, "full_outer")
    same = F.col("d0").eqNullSafe(F.col("d1")) & (F.col("d0").isNotNull() | F.col("s0").eqNullSafe(F.col("s1")))
    rows = both.withColumn("change", F.when(F.col("had").isNull(), "added").when(F.col("has").isNull(), "deleted").when(~same, "modified")).filter(F.col("change").isNotNull())
    rows = rows.select(*key, "change", F.coalesce("d1", "d0").alias("digest"))
    # only what was added or is gone is ranked within its digest
    moved = rows.filter("change <> 'modified' and digest is not null")
    turn = F.row_number().over(W.partitionBy(*by, "repo", "digest", "change").orderBy("path"))
    moved = moved.withColumn("turn", turn)
    meet = [*by, "repo", "digest", "turn"]
    to = moved.filter("change = 'added'").select(*meet, "path")
    of = moved.filter("change = 'deleted'").select(*meet, F.col("path").alias("was"))
    pairs = to.join(of, meet).select(*key, "was")
    gone = pairs.select(*by, "repo", F.col("was").alias("path"), F.lit(True).alias("gone"))
    out = rows.join(pairs, key, "left").join(gone, key, "left").filter(~((F.col("change") == "deleted") & F.col("gone").isNotNull()))
    return out.select(*key, F.when((F.col("change") == "added") & F.col("was").isNotNull(), "renamed").otherwise(F.col("change")).alias("change"), F.when(F.col("change") == "added", F.col("was")).alias("was"))


def to_scan(new: DataFrame, old: DataFrame | None, known: DataFrame | None = None) -> DataFrame:
    """repo, path of the files that a scan of changes reads: those that are new, changed or
    renamed since ``old``, and all files of a repository that is not among ``known``
    (repo; by default those that ``old`` has rows of). Without ``old`` all. A known
    repository in which nothing changed has none."""
    if old is None:
        return new.select("repo", "path")
    known = (old if known is None else known).select("repo").distinct()
    changed = changes(old, new).filter("change <> 'deleted'").select("repo", "path").join(known, "repo", "left_semi")
    return changed.unionByName(new.select("repo", "path").join(known, "repo", "left_anti"))


class Snapshots:
    """Manifests of one tree under names, each written once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._folder = spark, path, Folder(spark, path)

    def save(self, name: str, rows: DataFrame) -> None:
        rows.select("repo", "path", "digest", "size").write.parquet(f"{self.path}/{name}")

    def load(self, name: str | None) -> DataFrame | None:
        """The manifest of this name; None if there is none or its writing did not end."""
        done = name and "_SUCCESS" in self._folder.names(name)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/{name}") if done else None

    def scope(self, kind: str, new: DataFrame, previous: str | None = None, branch: str | None = None, baseline: str | None = None) -> DataFrame:
        """What a scan of this kind reads of ``new``: full, changed_files (since the
        snapshot ``previous``), branch_diff (against ``branch``), baseline_rescan (against
        ``baseline``). An unknown kind or a snapshot that is lost means all files."""
        name = {"changed_files": previous, "branch_diff": branch, "baseline_rescan": baseline}.get(kind.strip().lower())
        return to_scan(new, self.load(name))


def feed(manifests: DataFrame, order: list[str]) -> DataFrame:
    """snapshot, repo, path, change, was: what each snapshot of a repository changed since the
    one before. ``manifests`` has snapshot and the columns of ``order`` besides. The
    first snapshot of a repository adds all its files."""
    heads = manifests.select("repo", "snapshot", *order).distinct()
    steps = heads.withColumn("after", F.lead("snapshot").over(W.partitionBy("repo").orderBy(*order, "snapshot")))
    rows = manifests.select("snapshot", "repo", "path", "digest", "size")
    before = rows.join(steps.filter("after is not null").select("repo", "snapshot", "after"), ["repo", "snapshot"]).select(F.col("after").alias("snapshot"), "repo", "path", "digest", "size")
    return changes(before, rows, ["snapshot"])
