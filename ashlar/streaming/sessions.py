"""A keyed table under a stream of updates and deletes.

Rows lie in buckets by the hash of their key. A commit rewrites the buckets that its
keys touch, beside the ones that are there, and then writes the next manifest, which
names the folder of every bucket; readers follow the newest manifest, so a commit that
fails changes nothing and readers never see half of one. A table has one writer at a
time, as a stream has. The manifest keeps the
number of the last micro-batch of each writer: a batch that is delivered again
after a restart is known and left out, so counters are added exactly once.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.shared import Folder

DELETED = "deleted"
BUCKETS = 64


class KeyedTable:
    """``key`` columns, a column ``at`` that orders updates, and how others merge.

    Columns of ``merge`` are added up (``sum``) or kept at their largest (``max``);
    all others are those of the latest update, of which the newer batch wins ties. A row
    whose column ``deleted`` is true removes its key unless a later update is there; it
    stays in the files, unseen, so that an older update that comes late brings nothing
    back. Sums start anew after a deletion; where columns are added up, a deletion
    must not come in a later batch than updates that follow it.
    ``buckets`` is fixed when the table is made; ``keep`` manifests stay readable.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], at: str, merge: dict[str, str] | None = None, buckets: int = BUCKETS, keep: int = 2):
        self.spark, self.path, self.schema, self.key, self.at = spark, path, schema, key, at
        self.merge, self.buckets, self.keep = merge or {}, buckets, keep
        self.folder = Folder(spark, path)

    def version(self) -> int:
        """Number of the newest manifest; 0 for a new table."""
        return max((int(n) for n in self.folder.names("manifests") if n.isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"buckets": {}, "batches": {}}
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.path}/manifests/{version}").collect()))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets))

    def _rows(self, manifest: dict, only: set[int] | None = None) -> DataFrame:
        at = [f"{self.path}/data/{v}/bucket={b}" for b, v in manifest["buckets"].items() if only is None or int(b) in only]
        schema = f"{self.schema}, {DELETED} boolean"
        return self.spark.read.schema(schema).parquet(*at) if at else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of the newest manifest, or of an older one that is kept."""
        return self._rows(self.manifest(version)).filter(~F.col(DELETED)).drop(DELETED)

    def _commit(self, manifest: dict, rows: DataFrame, touched: set[int], writer: str, batch: int) -> None:
        version = self.version() + 1
        # a commit that failed may have left files of this version
        rows.withColumn("bucket", self._bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/{version}")
        made = {int(n.partition("=")[2]) for n in self.folder.names(f"data/{version}") if n.startswith("bucket=")}
        buckets = {b: v for b, v in manifest["buckets"].items() if int(b) not in touched} | {str(b): version for b in made}
        text = json.dumps({"buckets": buckets, "batches": manifest["batches"] | {writer: batch}})
        draft = f".{version}-{uuid.uuid4().hex}"
        self.folder.create(f"manifests/{draft}", text)
        if str(version) in self.folder.names("manifests") or not self.folder.rename(f"manifests/{draft}", f"manifests/{version}"):
            raise RuntimeError(f"version {version} of {self.path} was written by another writer")
        self._vacuum(version)

    def _vacuum(self, version: int) -> None:
        """Removes manifests before the last ``keep`` and buckets that none of those names."""
        kept = [v for v in range(max(1, version - self.keep + 1), version + 1)]
        named = {(str(v), b) for m in kept for b, v in self.manifest(m)["buckets"].items()}
        for old in self.folder.names("manifests"):
            if old.isdigit() and int(old) < kept[0]:
                self.folder.delete(f"manifests/{old}")
        for v in self.folder.names("data"):
            held = [n for n in self.folder.names(f"data/{v}") if n.startswith("bucket=")]
            gone = [n for n in held if (v, n.partition("=")[2]) not in named]
            for n in held and (["."] if len(gone) == len(held) else gone):
                self.folder.delete(f"data/{v}" if n == "." else f"data/{v}/{n}")

    def upsert(self, batch: DataFrame, number: int, writer: str = "batch") -> bool:
        """Merges a batch (the columns of the table, with or without ``deleted``); False if it was there."""
        manifest = self.manifest()
        if manifest["batches"].get(writer, -1) >= number:
            return False
        gone = F.coalesce(F.col(DELETED), F.lit(False)) if DELETED in batch.columns else F.lit(False)
        names = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
        batch = batch.withColumn(DELETED, gone).select(*names, DELETED)
        batch.persist()
        try:
            touched = {r[0] for r in batch.select(self._bucket().alias("b")).distinct().collect()}  # ``buckets`` numbers at most
            old = self._rows(manifest, touched).withColumn("__n", F.lit(0))
            both = old.unionByName(batch.withColumn("__n", F.lit(1)))
            rest = [c for c in names if c not in self.key and c not in self.merge]
            rank = F.struct(self.at, "__n")
            latest = both.groupBy(*self.key).agg(F.max_by(F.struct(*rest, DELETED), rank).alias("__r"), F.max(F.when(F.col(DELETED), rank)).alias("__d"))
            alive = both.join(latest.select(*self.key, "__d"), self.key).filter(F.col("__d").isNull() | (rank > F.col("__d")))
            sums = [(F.sum(c) if how == "sum" else F.max(c)).alias(c) for c, how in self.merge.items()]
            merged = latest.select(*self.key, *[F.col("__r")[c].alias(c) for c in [*rest, DELETED]])
            if sums:
                merged = merged.join(alive.groupBy(*self.key).agg(*sums), self.key, "left")
            self._commit(manifest, merged.select(*names, DELETED), touched, writer, number)
        finally:
            batch.unpersist()
        return True

    def replace(self, batch: DataFrame, by: str, number: int, writer: str = "batch") -> bool:
        """Rows of each value of ``by`` in the batch take the place of all rows of that
        value; ``by`` must be the whole key that buckets are made of."""
        if [by] != self.key:
            raise ValueError("rows are replaced by the key that buckets are made of")
        manifest = self.manifest()
        if manifest["batches"].get(writer, -1) >= number:
            return False
        batch = batch.select(*[f.name for f in self.spark.createDataFrame([], self.schema).schema]).withColumn(DELETED, F.lit(False))
        touched = {r[0] for r in batch.select(self._bucket().alias("b")).distinct().collect()}
        rows = self._rows(manifest, touched).join(batch.select(by).distinct(), by, "left_anti").select(*batch.columns).unionByName(batch)
        self._commit(manifest, rows, touched, writer, number)
        return True

    def remove(self, keys: DataFrame, number: int, writer: str = "batch") -> bool:
        """Removes the rows of these keys."""
        manifest = self.manifest()
        if manifest["batches"].get(writer, -1) >= number:
            return False
        keys = keys.select(*self.key).distinct()
        touched = {r[0] for r in keys.select(self._bucket().alias("b")).distinct().collect()}
        held = self._rows(manifest, touched)
        self._commit(manifest, held.join(keys, self.key, "left_anti").select(*held.columns), touched, writer, number)
        return True

    def follow(self, stream: DataFrame, checkpoint: str, writer: str) -> StreamingQuery:
        """Merges every micro-batch of a stream; stops when all that is there has been read."""
        put = lambda batch, number: self.upsert(batch, number, writer)
        return stream.writeStream.foreachBatch(lambda b, n: put(b, n) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
