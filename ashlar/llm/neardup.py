"""Near-duplicate texts by Order MinHash, verified by banded alignment.

A text is its lower-case words; its k-mers are shingles of five words, each
labelled with its occurrence number. For each of ``SKETCHES`` hash functions the
``ORDER`` smallest labelled shingles, put in text order, are hashed to one key:
texts that share many shingles in the same order share keys. Equal texts are one
node; nodes that share ``AGREE`` keys or more are candidates. A candidate is
linked if the Jaccard similarity of its shingle sets is ``SIMILARITY`` or more and
an alignment within the band that this allows matches that share of the words in
order. Classes are the connected components of the links.

Candidates are searched in two steps, which hold for buckets of any size:

1. Every node of a bucket is compared with its hub alone, the node whose buckets
   are fullest, as the original of many copies is. So the pairs grow with the
   nodes, and what links is one class.
2. A pair that is left lies in two classes and shares ``AGREE`` buckets, each of
   which holds both. The nodes of such buckets (similar sets have similar sizes,
   so buckets are split by size first) are searched by a prefix filter: of two sets
   of the similarity ``SIMILARITY`` the first ``1 - SIMILARITY`` of each share a
   shingle, early enough in both. Rare shingles come first, so passages that many
   texts share bring no pairs, and of the nodes that hold one shingle those of the
   largest class meet only the others. This is exact: no link is lost to the size
   of a bucket, and no pair within one class is tried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, release, table
from .components import components

SHINGLE = 5
SIMILARITY = 0.8
ORDER, SKETCHES, AGREE = 3, 20, 2
#: Rows of one shingle that meet the others of it in one block of the join.
BLOCK = 1024

_RNG = np.random.default_rng(20_000_003)
_ODD = _RNG.integers(1, 2**63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _RNG.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Word numbers, the same in every process; a bounded memory of words seen."""

    def __init__(self, most: int = 500_000):
        self.seen, self.most = {}, most

    def __call__(self, text: str) -> np.ndarray:
        words = text.lower().split()
        get, seen = self.seen.get, self.seen
        out = []
        for w in words:
            v = get(w)
            if v is None:
                v = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
                if len(seen) >= self.most:
                    seen.clear()
                seen[w] = v
            out.append(v)
        return np.array(out, np.uint64)


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """Hash of each run of five words; of all words if there are fewer."""
    k = min(SHINGLE, len(words))
    if not k:
        return np.zeros(0, np.uint64)
    n = len(words) - k + 1
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = _scramble(h + words[i : i + n] * _MIX[i] + np.uint64(k))
    return h


def sketch(words: np.ndarray) -> tuple[np.ndarray, int]:
    """The keys of a text, one for each hash function, none for no words; and the
    number of its distinct shingles."""
    h = shingle_hashes(words)
    n = len(h)
    if not n:
        return np.zeros(0, np.int64), 0
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.r_[True, s[1:] != s[:-1]]
    size = int(first.sum())
    if size < n:
        starts = np.flatnonzero(first)
        occurrence = np.empty(n, np.uint64)
        occurrence[order] = np.arange(n, dtype=np.uint64) - np.repeat(starts, np.diff(np.r_[starts, n])).astype(np.uint64)
        h = _scramble(h + occurrence * _GOLD)
    take = min(ORDER, n)
    keys = np.arange(1, SKETCHES + 1, dtype=np.uint64)  # the hash function's number is part of its key
    step = max(1, 400_000 // n)  # hash functions at once, so that long texts need no more memory
    for j in range(0, SKETCHES, step):
        v = h[None, :] * _ODD[j : j + step, None]
        at = np.sort(np.argpartition(v, take - 1, axis=1)[:, :take], axis=1) if take < n else np.tile(np.arange(n), (len(v), 1))
        for p in range(take):
            keys[j : j + step] = _scramble(keys[j : j + step] * _MIX[0] + h[at[:, p]])
    return keys.view(np.int64), size


def _common(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def aligned(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Words inserted and deleted by the shortest edit from a to b, searched
    within ``most`` diagonals around the main one; None if it takes more."""
    p = _common(a, b)
    a, b = a[p:], b[p:]
    p = _common(a[::-1], b[::-1])
    a, b = a[: len(a) - p], b[: len(b) - p]
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    if not n or not m:
        return n + m
    # Furthest-reaching paths, all diagonals of a round at once; common runs are
    # found by comparing prefix hashes at doubling, then halving steps.
    base = np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    longest = max(n, m) + 1
    power = np.cumprod(np.full(longest, base, np.uint64))
    power = np.r_[np.uint64(1), power]
    inverse = pow(int(base), -1, 1 << 64)
    down = np.cumprod(np.full(longest, np.uint64(inverse)))
    down = np.r_[np.uint64(1), down]
    pa = np.r_[np.uint64(0), np.cumsum(_scramble(a + _GOLD) * power[:n])]
    pb = np.r_[np.uint64(0), np.cumsum(_scramble(b + _GOLD) * power[:m])]
    top = max(1, int(longest).bit_length())

    def run(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        total = np.zeros_like(x)
        for e in range(top, -1, -1):
            step = 1 << e
            nx, ny = x + total + step, y + total + step
            ok = (nx <= n) & (ny <= m)
            i, j = np.where(ok, nx, 0), np.where(ok, ny, 0)
            fx, fy = np.where(ok, x + total, 0), np.where(ok, y + total, 0)
            same = (pa[i] - pa[fx]) * down[fx] == (pb[j] - pb[fy]) * down[fy]
            total += np.where(ok & same, step, 0)
        return total

    k = np.array([0])
    x = np.array([0])
    x = x + run(x, x - k)
    for d in range(most + 1):
        if d:
            full = np.full(2 * d + 3, -1, np.int64)
            full[2 : 2 + 2 * len(x) : 2] = x
            left, right = full[0 : 2 * d + 1 : 2], full[2 : 2 * d + 3 : 2]
            k = np.arange(-d, d + 1, 2)
            x = np.maximum(left + 1, right)
            x = np.where((x > n) | (x - k > m) | (x < 0) | (x - k < 0), -2, x)
            live = x >= 0
            x[live] += run(x[live], (x - k)[live])
        if ((x == n) & (x - k == m)).any():
            return d
    return None


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Shingle Jaccard and share of words aligned in order are both ``least`` or more."""
    sa, sb = np.unique(shingle_hashes(a)), np.unique(shingle_hashes(b))
    both = len(np.intersect1d(sa, sb, assume_unique=True))
    if both < least * (len(sa) + len(sb) - both) or not both:
        return False
    return aligned(a, b, int((1.0 - least) * (len(a) + len(b)) + 1e-9)) is not None


def _sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    words = Words()
    for b in batches:
        made = [sketch(words(t)) for t in b["text"]]
        yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "node": b["node"], "keys": [k for k, _ in made], "size": [n for _, n in made]})


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    words, last, wa = Words(), None, None
    for batch in batches:
        keep = []
        for a, ta, tb in zip(batch["a"], batch["text_a"], batch["text_b"], strict=True):
            if a != last:
                last, wa = a, words(ta)
            keep.append(similar(wa, words(tb)))
        yield batch.loc[keep, ["a", "b"]]


def _shingled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    words = Words()
    for b in batches:
        yield pd.DataFrame({"node": b["node"], "shingles": [np.unique(shingle_hashes(words(t))).view(np.int64) for t in b["text"]]})


def _may_be_alike(a: str, b: str) -> Column:
    """Sets of these sizes can have the similarity."""
    return F.least(a, b) >= SIMILARITY * F.greatest(a, b) - 1e-6


def _agreeing(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that share ``AGREE`` keys or more."""
    keys = lambda x: nodes.select(F.col("node").alias(x), F.col("keys").alias(f"keys_{x}"))
    both = pairs.join(keys("b"), "b").join(keys("a"), "a")
    shared = F.aggregate(F.zip_with("keys_a", "keys_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return both.filter(shared >= AGREE).select("a", "b")


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are similar. The many ``b`` get their texts
    first, so that the text of an ``a`` of many pairs is sent once."""
    joined = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    joined = joined.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")
    return durable(joined.mapInPandas(_verified, "a long, b long"), "links")


def _texts(needed: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """node, text: one text of each needed node. They meet on node and id, so a
    text that many rows repeat is no hot key."""
    gid = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("gid")
    text = F.coalesce("text", F.lit(""))
    first = needed.join(nodes, "node").select("node", gid)
    texts = docs.select(F.xxhash64(text).alias("node"), gid, text.alias("text"))
    texts = first.join(texts.hint("merge"), ["node", "gid"])
    return durable(texts.groupBy("node", "gid").agg(F.any_value("text").alias("text")).select("node", "text"), "texts")


def _across(crowd: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of different roots in ``crowd`` (node, root, size) whose
    shingle sets can have the similarity ``SIMILARITY``; none that has it is missing.

    Shingles are ordered by the number of texts that hold them. Those of one
    text come first and pair nothing, so only their number is needed.
    """
    sets = crowd.select("node", "size").join(texts, "node").select("node", "size", "text")
    sets = durable(sets.select("node", "text").mapInPandas(_shingled, "node long, shingles array<long>"), "shingles")
    each = sets.select("node", F.explode("shingles").alias("shingle"))
    held = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    order = each.join(held, "shingle").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("held", "shingle"))).alias("order"))
    order = order.join(crowd, "node").withColumn("own", F.col("size") - F.size("order"))
    first = F.floor(F.col("size") * (1.0 - SIMILARITY) + 1e-9).cast("int") + 1
    prefix = order.withColumn("first", first).filter("first > own").select("node", "root", "size", "own", F.posexplode(F.slice("order", F.lit(1), F.col("first") - F.col("own"))).alias("i", "s"))
    prefix = durable(prefix.select("node", "root", "size", F.col("s.shingle").alias("shingle"), (F.col("own") + F.col("i")).alias("place")), "prefixes")
    classes_of = prefix.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("shingle")
    top = classes_of.agg(F.max(F.struct("n", "root"))["root"].alias("top"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    top = durable(top.select("shingle", "top", F.ceil(F.col("n") / F.lit(float(BLOCK))).cast("int").alias("blocks")), "tops")  # so that Spark can split the join below
    prefix = prefix.join(top, "shingle")
    side = lambda rows, x, block: rows.select("shingle", block.alias("block"), "top" if x == "a_" else F.col("top").alias("t"), *[F.col(c).alias(x + c) for c in ("node", "root", "size", "place")])
    left = side(prefix.filter("root <> top"), "a_", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = side(prefix, "b_", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).drop("t")
    # The first shingle that a similar pair has in common leaves enough behind it in both.
    behind = F.least(F.col("a_size") - F.col("a_place"), F.col("b_size") - F.col("b_place"))
    enough = behind * (1.0 + SIMILARITY) >= SIMILARITY * (F.col("a_size") + F.col("b_size")) - 1e-6
    both = left.join(right, ["shingle", "block"]).filter(F.expr("a_root <> b_root and (b_root = top or a_node < b_node)") & enough)
    pair = (F.col("b_node").alias("a"), F.col("a_node").alias("b"))  # a node of the largest class may have many partners
    return durable(both.select(*pair).distinct(), "across")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, node, class_id, root: for every row of ``docs`` the hash of its
    text, the least doc_id of its class, and the class itself (its least hash).

    A null text is an empty one; texts without words are copies of each other
    only if equal. Null ids count as larger than any. Columns other than doc_id
    and text are not read; rows that repeat are copies.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("node"), text.alias("text"))
    signed = durable(rows.mapInPandas(_sketched, "doc_id long, node long, keys array<long>, size int"), "sketches")
    nodes = durable(signed.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.any_value("keys").alias("keys"), F.any_value("size").alias("size")), "nodes")

    entries = nodes.select(F.explode("keys").alias("key"), "node", "size")
    buckets = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = durable(entries.join(buckets, "key"), "shared")
    # The hub of a bucket: the node whose buckets are fullest in sum. A node without AGREE buckets has no candidate.
    fullness = shared.groupBy("node").agg(F.sum("n").alias("fullness"), F.count(F.lit(1)).alias("c")).filter(F.col("c") >= AGREE).select("node", "fullness")
    shared = durable(shared.join(fullness, "node").select("key", "node", "size", "fullness"), "spokes")
    hubs = shared.groupBy("key").agg(F.max(F.struct("fullness", "node", "size")).alias("h")).select("key", F.col("h.node").alias("hub"), F.col("h.size").alias("hub_size"))
    star = shared.join(hubs, "key").filter((F.col("node") != F.col("hub")) & _may_be_alike("size", "hub_size"))
    star = durable(_agreeing(star.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), nodes), "pairs")
    texts = _texts(fullness.select("node"), nodes, docs)
    found = components(_links(star, texts))

    # Each bucket that two classes share, by size: sets of a similarity have sizes of one class or of two that follow.
    placed = shared.select("key", "node", "size").join(found.select(F.col("id").alias("node"), "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    size_class = F.floor(F.log(F.col("size").cast("double")) / -F.log(F.lit(SIMILARITY)) + 1e-9)
    placed = placed.withColumn("c", F.explode(F.array(size_class, size_class + 1)))
    mixed = placed.groupBy("key", "c").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key", "c")
    crowd = placed.join(mixed, ["key", "c"]).groupBy("node", "root", "size").agg(F.count_distinct("key").alias("c")).filter(F.col("c") >= AGREE).select("node", "root", "size")
    crowd = durable(crowd, "crowd")
    fresh = _links(durable(_agreeing(_across(crowd, texts), nodes), "pairs"), texts)
    if not fresh.isEmpty():
        found = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(fresh))
    release(texts)

    member = nodes.select("node", "doc_id").join(found.select(F.col("id").alias("node"), "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = member.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    member = member.join(least, "root").select("node", "class_id", "root")
    return signed.select("doc_id", "node").join(member, "node")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each class, the one of the least id; all columns kept."""
    # The row of a class is chosen by its root: ids may be null or repeat in others.
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("s")
    kept = classes(docs).groupBy("root").agg(least).select(F.col("s.doc_id").alias("__id"), F.col("s.node").alias("__node"))
    rows = docs.withColumn("__h", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = rows.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__node")))
    once = F.row_number().over(W.partitionBy("__h").orderBy("__id"))  # a text is in one class
    return rows.withColumn("__n", once).filter("__n = 1").select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


QUERIES = {"op1_near_dedup": op1_near_dedup}
ORACLES: dict[str, str] = {}
