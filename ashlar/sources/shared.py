"""Folders that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new folder below ``spark.checkpoint.dir``. Only where that is unset and driver
    and executors are one process, a temporary folder is made once a session."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="ashlar-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a Parquet table in a shared folder, read again."""
    path = shared_dir(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Folder:
    """A folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark._jvm
        self.path, self._at = path, jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, below: str = "") -> list[str]:
        where = self._at(f"{self.path}/{below}" if below else self.path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def glob(self, pattern: str) -> list[str]:
        """Full paths that match the pattern below the folder."""
        return sorted(s.getPath().toString() for s in self._fs.globStatus(self._at(f"{self.path}/{pattern}")) or [])

    def create(self, name: str, text: str) -> None:
        """Writes a new file; fails if there is one."""
        out = self._fs.create(self._at(f"{self.path}/{name}"), False)
        out.write(bytearray(text.encode()))
        out.close()

    def rename(self, old: str, new: str) -> bool:
        return self._fs.rename(self._at(f"{self.path}/{old}"), self._at(f"{self.path}/{new}"))

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(f"{self.path}/{name}"), True)
