"""Deleted files of git repositories as a Spark data source.

``spark.read.format("git_deleted").option("repos", "a=/clones/a,b=/clones/b").load()``
reads one partition a repository: a task streams ``git log`` and asks ``git show`` for
the last text of each deleted file, so that neither the log nor the texts pass the
driver. The clones must be readable where tasks run.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import NAMES, SKIP_DIRS, SKIP_FILES, SUFFIXES

SCHEMA = "repo string, position long, commit string, path string, content string"
LOG = ("log", "--all", "--diff-filter=D", "--name-only", "--no-renames", "-z", "--format=%x01%H")
DEFAULTS = {"most": "200", "max_chars": "500000", "timeout": "10"}


@dataclass
class Clone(InputPartition):
    name: str
    path: str


def wanted(path: str) -> bool:
    """The rule of ``files.scannable`` for one path."""
    *folders, name = path.split("/")
    skipped = any(p in SKIP_DIRS or p.endswith(".egg-info") for p in folders)
    suffix = os.path.splitext(name)[1].lower() if not name.startswith(".") or "." in name[1:] else name.lower()
    return not skipped and name not in SKIP_FILES and (name in NAMES or suffix in SUFFIXES)


def deletions(clone: str) -> Iterator[tuple[str, str]]:
    """(commit, path) of every deleted file that is read, newest commits first, as git writes them."""
    with subprocess.Popen(["git", "-C", clone, *LOG], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL) as log:
        commit, rest = "", b""
        while block := log.stdout.read(1 << 16):
            *items, rest = (rest + block).split(b"\0")
            for item in items:
                text = item.decode("utf-8", "replace").strip("\n")
                if text.startswith("\x01"):
                    commit, _, text = text[1:].partition("\n")
                if text and wanted(text):
                    yield commit, text
        last = rest.decode("utf-8", "replace").strip("\n")
        if last and not last.startswith("\x01") and wanted(last):
            yield commit, last
        log.stdout.close()
        log.kill()


def last_text(clone: str, commit: str, path: str, timeout: float) -> str | None:
    """The file's content in the commit before the one that deleted it."""
    try:
        got = subprocess.run(["git", "-C", clone, "show", f"{commit}~1:{path}"], capture_output=True, timeout=timeout, check=True)
    except (subprocess.SubprocessError, OSError):
        return None
    return got.stdout.decode("utf-8", "replace")


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.given = {**DEFAULTS, **{k: options[k] for k in (*DEFAULTS, "repos", "root") if k in options}}

    def _bound(self, key: str) -> int | None:
        return None if self.given[key].lower() == "all" else int(self.given[key])

    def partitions(self) -> list[Clone]:
        if "repos" in self.given:
            return [Clone(*(x.strip() for x in item.split("=", 1))) for item in self.given["repos"].split(",") if item.strip()]
        root = self.given["root"]
        return [Clone(n, f"{root}/{n}") for n in sorted(os.listdir(root)) if os.path.exists(f"{root}/{n}/.git") or os.path.exists(f"{root}/{n}/HEAD")]

    def read(self, partition: Clone) -> Iterator[tuple]:
        most, longest, timeout = self._bound("most"), self._bound("max_chars"), float(self.given["timeout"])
        seen: set[str] = set()
        for position, (commit, path) in enumerate(deletions(partition.path)):
            if most is not None and position >= most:
                return
            if path in seen:
                continue
            seen.add(path)
            text = last_text(partition.path, commit, path, timeout)
            if text and (longest is None or len(text) <= longest):
                yield partition.name, position, commit, path, text


class DeletedFiles(DataSource):
    """Newest deletion of each path with its last text. Options: ``repos`` (name=path, by
    commas) or ``root`` (a folder of clones); ``most`` entries of a log count and texts of
    up to ``max_chars`` are read, ``all`` for no bound; ``timeout`` seconds a text."""

    @classmethod
    def name(cls) -> str:
        return "git_deleted"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DeletedFiles)
