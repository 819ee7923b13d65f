"""Embedding near-dedup on an inverted multi-index.

Unit vectors are cut into halves, each with a codebook of k-means centres, whose
product is a grid of cells; every distinct vector is indexed in the cell of its
two nearest centres. A query visits cells in order of the sum of its two squared
distances (multi-sequence traversal) and is compared with all vectors there. A link
is found if either end visits the other's cell. How many cells are visited is
measured on two sorts of links, of which the one that needs more counts: the true links of
sample queries to all other vectors, found by brute force, of which ``TARGET`` are to be
reached, and, as a table may hold too few of those to learn from, links made for the
purpose, which are as long as a link can be and of which ``PLANTED`` are to be reached.

The grid grows with the root of the number of vectors, so a cell holds
``CELL_ROWS`` on the mean. Equal vectors are one entry with a count. Cells are
split into blocks of ``BLOCK`` index rows and ``BLOCK`` visiting queries, so a
crowded cell is many tasks; a block gives the sums of links of its rows and edges
that join what is linked there, never its pairs.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, table
from .components import components

COSINE = 0.9
CELL_ROWS = 256
MAX_CENTRES = 512
SAMPLE, SAMPLE_QUERIES, SAMPLE_PLANTED = 20_000, 400, 2_000
ENOUGH_LINKS, MOST_COMPARED = 1_000, 2_000_000_000
TARGET, PLANTED = 0.995, 0.95
BLOCK = 2048


def unit(values) -> np.ndarray | None:
    """The vector divided by its length; None if it is null, empty, zero, or
    holds null or non-finite components."""
    if values is None or not len(values):
        return None
    x = np.array([np.nan if v is None else v for v in values], np.float64) if getattr(values, "dtype", None) == object or isinstance(values, list) else np.asarray(values, np.float64)
    if not np.isfinite(x).all():
        return None
    top = np.abs(x).max()
    if not top > 0:
        return None
    x = x / top
    return x / math.sqrt(float(x @ x))


def centres(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k-means centres of the rows of x; fewer where rows repeat."""
    rng = np.random.default_rng(11)
    c = np.unique(x[rng.choice(len(x), min(k, len(x)), replace=False)], axis=0)
    for _ in range(rounds):
        near = (c @ x.T - 0.5 * (c * c).sum(1)[:, None]).argmax(0)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(c))
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def traverse(d1: np.ndarray, d2: np.ndarray, most: int) -> list[tuple[int, int]]:
    """The first ``most`` pairs of places in two ascending lists by their sum."""
    out, heap, seen = [], [(float(d1[0] + d2[0]), 0, 0)], {(0, 0)}
    while heap and len(out) < most:
        _, i, j = heapq.heappop(heap)
        out.append((i, j))
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(d1) and b < len(d2) and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (float(d1[a] + d2[b]), a, b))
    return out


class MultiIndex:
    """Two codebooks and the number of cells a query visits."""

    def __init__(self, sample: np.ndarray, n: int):
        half = sample.shape[1] // 2
        self.half = half
        k = min(MAX_CENTRES, max(1, math.ceil(math.sqrt(n / CELL_ROWS))), len(sample))
        self.books = [centres(sample[:, :half], k), centres(sample[:, half:], k)] if half else [np.zeros((1, 0)), centres(sample, k)]
        self.width = len(self.books[1])
        self.visits = len(self.books[0]) * self.width  # all, until calibrated

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple((c * c).sum(1)[None, :] - 2.0 * (h @ c.T) for c, h in zip(self.books, (x[:, : self.half], x[:, self.half :]), strict=True))

    def homes(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(1) * self.width + b.argmin(1)

    def visited(self, x: np.ndarray, most: int | None = None) -> list[list[int]]:
        a, b = self.distances(x)
        oa, ob = a.argsort(1, kind="stable"), b.argsort(1, kind="stable")
        sa, sb = np.take_along_axis(a, oa, 1), np.take_along_axis(b, ob, 1)
        most = most or self.visits
        return [[int(oa[r, i]) * self.width + int(ob[r, j]) for i, j in traverse(sa[r], sb[r], most)] for r in range(len(x))]

    def rank(self, a: np.ndarray, b: np.ndarray, cell: int) -> int:
        """Place of a cell in the traversal of a query with distances a and b."""
        far = a[cell // self.width] + b[cell % self.width]
        return int(np.searchsorted(np.sort(b), far - a + 1e-12, side="right").sum())


    def pair_ranks(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For pairs of rows how far the end that is nearer has to go to the other's cell."""
        (xa, xb), (ya, yb) = self.distances(x), self.distances(y)
        hx, hy = xa.argmin(1) * self.width + xb.argmin(1), ya.argmin(1) * self.width + yb.argmin(1)
        return np.array([min(self.rank(xa[i], xb[i], hy[i]), self.rank(ya[i], yb[i], hx[i])) for i in range(len(x))], dtype=np.int64)


def planted(x: np.ndarray, cosine: float, seed: int = 5) -> np.ndarray:
    """A partner at exactly ``cosine`` for each row: half in random directions, half in
    those of other rows, as a table's vectors may vary in a few directions only."""
    rng = np.random.default_rng(seed)
    r = rng.normal(size=x.shape)
    half = len(x) // 2
    r[half:] = x[rng.integers(0, len(x), len(x) - half)] - x[half:]
    r -= (r * x).sum(1)[:, None] * x
    size = np.linalg.norm(r, axis=1)[:, None]
    return cosine * x + math.sqrt(1.0 - cosine * cosine) * np.where(size > 1e-9, r / np.maximum(size, 1e-9), 0.0)


def link_ranks(nodes: DataFrame, index: MultiIndex, asked: np.ndarray, queries: np.ndarray, cosine: float) -> list[tuple[int, int]]:
    """(rank, links) of all links of the queries (their nodes are ``asked``) to ``nodes``
    but themselves: every row is compared with every query, in tasks."""

    def ranked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.array(batch["x"].tolist())
                q, hit = np.nonzero((queries @ x.T >= cosine) & (asked[:, None] != batch["node"].to_numpy()[None, :]))
                found, n = np.unique(np.concatenate([index.pair_ranks(queries[q[at : at + 4096]], x[hit[at : at + 4096]]) for at in range(0, len(q), 4096)] or [np.zeros(0, np.int64)]), return_counts=True)
                yield pd.DataFrame({"rank": found.astype("int64"), "n": n.astype("int64")})

    ranks = nodes.select("node", "x").mapInPandas(ranked, "rank long, n long").groupBy("rank").agg(F.sum("n").alias("n"))
    return sorted((r["rank"], r["n"]) for r in ranks.collect())  # a row a rank, so no more than cells


def calibrated(nodes: DataFrame, n: int, index: MultiIndex, sample: np.ndarray, cosine: float) -> int:
    """Cells that a query visits, so that ``TARGET`` of the true links of sample queries
    and ``PLANTED`` of planted links are found. The queries grow fourfold until they have
    ``ENOUGH_LINKS``, are the whole table, or would compare ``MOST_COMPARED`` pairs."""
    base = sample[:SAMPLE_PLANTED]
    far = np.sort(index.pair_ranks(base, planted(base, cosine)))
    need = int(far[min(len(far) - 1, math.ceil(PLANTED * len(far)) - 1)])
    size = SAMPLE_QUERIES
    while True:
        asked = nodes.orderBy(F.xxhash64("node", F.lit(1))).limit(size).select("node", "x").collect()  # not those that lie nearest to centres
        ranks = link_ranks(nodes, index, np.array([s["node"] for s in asked]), np.array([s["x"] for s in asked]), cosine)
        if sum(k for _, k in ranks) >= ENOUGH_LINKS or size >= n or 4 * size * n > MOST_COMPARED:
            break
        size *= 4
    if ranks:
        reached = np.cumsum([k for _, k in ranks])
        need = max(need, ranks[int(np.searchsorted(reached, TARGET * reached[-1]))][0])
    return int(min(len(index.books[0]) * index.width, need + 1))


def links(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id,
    embedding; other columns are not read).

    Rows that repeat an id are vectors of their own; null ids are as well, and
    count as larger than any. Vectors without direction (see ``unit``) link with
    nothing, and vectors of different lengths do not link.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")

    def prepared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = [unit(v) for v in b["embedding"]]
            yield pd.DataFrame({"vec_id": b["vec_id"].astype("Int64"), "x": x, "dim": [0 if v is None else len(v) for v in x]})

    rows = rows.mapInPandas(prepared, "vec_id long, x array<double>, dim int")
    rows = durable(rows.withColumn("node", F.when(F.col("dim") > 0, F.xxhash64("x"))), "vectors")
    nodes = durable(rows.filter("dim > 0").groupBy("node", "dim").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.any_value("x").alias("x")), "vector-nodes")

    sums, edges = [], []
    for r in nodes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy("dim").collect():  # one row a length of vectors
        part = nodes.filter(F.col("dim") == r["dim"])
        sample = part.orderBy(F.xxhash64("node")).limit(SAMPLE).select("x").collect()  # a bounded sample trains the codebooks
        sample = np.array([s["x"] for s in sample])
        index = MultiIndex(sample, r["n"])
        index.visits = calibrated(part, r["n"], index, sample, cosine)
        found = _searched(part, index, cosine)
        sums.append(found.filter("b is null").select(F.col("a").alias("node"), "n"))
        edges.append(found.filter("b is not null").select("a", "b"))
    none = rows.sparkSession.createDataFrame([], "node long, n long")
    total, pairs = none, rows.sparkSession.createDataFrame([], "a long, b long")
    for s, e in zip(sums, edges, strict=True):
        total, pairs = total.unionByName(s), pairs.unionByName(e)
    total = total.groupBy("node").agg(F.sum("n").alias("n"))
    found = components(pairs)
    member = nodes.select("node", "least", "copies").join(found.select(F.col("id").alias("node"), "root"), "node", "left").join(total, "node", "left")
    member = member.withColumn("root", F.coalesce("root", "node"))
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    member = member.join(least, "root").select("node", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "node").join(member, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def _searched(nodes: DataFrame, index: MultiIndex, cosine: float) -> DataFrame:
    """a, b, n: for a node the links found in one block (b null), and edges."""

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.array(b["x"].tolist())
                yield pd.DataFrame({"node": b["node"], "copies": b["copies"], "x": b["x"], "home": index.homes(x), "cells": index.visited(x)})

    homed = durable(nodes.select("node", "copies", "x").mapInPandas(placed, "node long, copies long, x array<double>, home int, cells array<int>"), "cells")
    queries = homed.select("node", "copies", "x", "home", "cells", F.explode("cells").alias("cell"))
    held = homed.groupBy(F.col("home").alias("cell")).agg(F.ceil(F.count(F.lit(1)) / F.lit(float(BLOCK))).cast("int").alias("ib"))
    asked = queries.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(BLOCK))).cast("int").alias("qb"))
    blocks = durable(held.join(asked, "cell"), "blocks")
    mine = lambda of, n: F.pmod(F.xxhash64(F.col("node"), F.lit(of)), F.col(n)).cast("int")
    stored = homed.withColumn("cell", F.col("home")).join(blocks, "cell").withColumn("i", mine(1, "ib")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("qb") - 1)))
    queries = queries.join(blocks, "cell").withColumn("q", mine(2, "qb")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("ib") - 1)))
    shared = ["cell", "i", "q", "node", "copies", "x"]  # a visiting query tells its home, a stored vector the cells it visits

    def compared(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """left: visiting queries; right: vectors of the cell."""
        none = pd.DataFrame({"a": pd.Series([], dtype="int64"), "b": pd.Series([], dtype="Int64"), "n": pd.Series([], dtype="int64")})
        if not len(left) or not len(right):
            return none
        xq, xi = np.array(left["x"].tolist()), np.array(right["x"].tolist())
        nq, ni = left["node"].to_numpy(), right["node"].to_numpy()
        rows, cols = np.nonzero((xq @ xi.T >= cosine) & (nq[:, None] != ni[None, :]))
        if not len(rows):
            return none
        # A query counts what it finds; the vector found counts the query too,
        # unless it visits the query's cell and finds it there itself.
        sees = np.fromiter((h in c for h, c in zip(left["home"].to_numpy()[rows], right["cells"].to_numpy()[cols], strict=True)), bool, len(rows))
        n_q = np.bincount(rows, right["copies"].to_numpy()[cols], len(xq))
        n_i = np.bincount(cols[~sees], left["copies"].to_numpy()[rows[~sees]], len(xi))
        # Edges that join all that is linked in the block: least labels, passed on until they rest.
        label = np.unique(np.r_[nq, ni])
        a, b = np.searchsorted(label, nq)[rows], np.searchsorted(label, ni)[cols]
        root = np.arange(len(label))
        while True:
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        moved = np.flatnonzero(root != np.arange(len(label)))
        sums = pd.DataFrame({"a": np.r_[nq, ni], "b": pd.array([None] * (len(nq) + len(ni)), "Int64"), "n": np.r_[n_q, n_i].astype("int64")})
        return pd.concat([sums[sums["n"] > 0], pd.DataFrame({"a": label[moved], "b": pd.array(label[root[moved]], "Int64"), "n": 0})])

    columns = [*shared, "cells"]
    stored = stored.select([F.col(c).alias(f"{c}_") for c in columns]).toDF(*columns)  # columns of its own: both sides read one table
    both = queries.select(*shared, "home").groupBy("cell", "i", "q").cogroup(stored.groupBy("cell", "i", "q"))
    return durable(both.applyInPandas(compared, "a long, b long, n long"), "vector-links")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(table(spark, sf_dir, "embeddings"))


OP3_SQL = """
with recursive v as (
  select vec_id, list_transform(embedding, lambda e: e::double) as e from embeddings
), u as (
  select vec_id, e, sqrt(list_dot_product(e, e)) as norm from v
), link as (
  select a.vec_id as x, b.vec_id as y from u a join u b on a.vec_id <> b.vec_id and list_dot_product(a.e, b.e) >= 0.9 * a.norm * b.norm where a.norm > 0 and b.norm > 0
), reach(x, y) as (
  select vec_id, vec_id from u union select r.x, l.y from reach r join link l on r.y = l.x
)
select u.vec_id, (select count(*) from link where link.x = u.vec_id) as n_links, c.y as component_id, u.vec_id = c.y as kept
from u join (select x, min(y) as y from reach group by x) c on c.x = u.vec_id
"""
QUERIES = {"op3_embedding_dedup": op3_embedding_dedup}
ORACLES = {"op3_embedding_dedup": OP3_SQL}
