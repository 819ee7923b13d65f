"""Repository graph and portfolio analytics."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Roles that each role may depend on (fixed values of the boundary rules).
ALLOWED_TARGETS = {"ui": ("api", "service"), "api": ("service", "platform", "library"), "worker": ("service", "platform", "library"), "service": ("service", "platform", "library"), "platform": ("platform", "library")}


def attribute_rollup(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """kind, value, n: counts of the values of many columns (arrays are exploded) in one pass."""
    types = dict(df.dtypes)
    pair = lambda k: lambda v: F.struct(F.lit(k).alias("kind"), v.cast("string").alias("value"))
    parts = [F.transform(F.col(c) if types[c].startswith("array") else F.array(F.col(c)), pair(k)) for k, c in columns.items()]
    return df.select(F.explode(F.flatten(F.array(*parts))).alias("x")).groupBy("x.kind", "x.value").agg(F.count(F.lit(1)).alias("n"))


def tag_classes(df: DataFrame, key: str, tags: str) -> DataFrame:
    """``df`` with ``rep``: the least key of all rows that have the same tags."""
    rows = df.withColumn("__tags", F.array_sort(F.array_distinct(tags)))
    reps = rows.groupBy("__tags").agg(F.min(key).alias("rep"))
    return rows.join(reps, "__tags").drop("__tags")


def overlaps(df: DataFrame, key: str, tags: str, least: int) -> DataFrame:
    """a, b, shared, pairs: classes of rows of equal tags (see ``tag_classes``) that
    share ``least`` tags or more, and the number of pairs of rows that they stand
    for; a class with itself counts its own pairs. Classes meet on a tag, so rows
    that many others equal are never paired, and what is joined is bounded by the
    distinct sets of tags."""
    sets = df.groupBy(F.array_sort(F.array_distinct(tags)).alias("s")).agg(F.min(key).alias("k"), F.count(F.lit(1)).alias("n"))
    rows = sets.select("k", "n", F.explode("s").alias("t"))
    both = rows.select(F.col("k").alias("a"), F.col("n").alias("na"), "t").join(rows.select(F.col("k").alias("b"), F.col("n").alias("nb"), "t"), "t").filter("a <= b")
    both = both.groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("shared")).filter((F.col("shared") >= least) & F.expr("a < b or na > 1"))
    pairs = F.when(F.col("a") == F.col("b"), F.floor(F.col("na") * (F.col("na") - 1) / 2)).otherwise(F.col("na") * F.col("nb")).cast("long")
    return both.select("a", "b", "shared", pairs.alias("pairs"))


def two_cycles(edges: DataFrame) -> DataFrame:
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.join(back, ["src", "dst"], "left_semi").filter("src < dst")


def degrees(edges: DataFrame) -> DataFrame:
    end = lambda c, out: F.struct(F.col(c).alias("repo"), F.lit(out).alias("o"), F.lit(1 - out).alias("i"))
    ends = edges.select(F.explode(F.array(end("src", 1), end("dst", 0))).alias("e"))
    got = ends.groupBy("e.repo").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))
    return got.withColumn("centrality", F.col("in_degree") + F.col("out_degree"))


def flows(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """Edges between repos of different owners, counted by owner pair."""
    a = edges.join(owners.select(F.col("repo").alias("src"), F.col("owner").alias("src_owner")), "src")
    b = a.join(owners.select(F.col("repo").alias("dst"), F.col("owner").alias("dst_owner")), "dst")
    return b.filter("src_owner <> dst_owner").groupBy("src_owner", "dst_owner").agg(F.count(F.lit(1)).alias("n"))


def boundary_violations(edges: DataFrame, roles: DataFrame, allowed: dict = ALLOWED_TARGETS) -> DataFrame:
    a = edges.join(roles.select(F.col("repo").alias("src"), F.col("role").alias("src_role")), "src")
    b = a.join(roles.select(F.col("repo").alias("dst"), F.col("role").alias("dst_role")), "dst")
    fine = F.lit(False)
    for role, targets in allowed.items():
        fine = fine | ((F.col("src_role") == role) & F.col("dst_role").isin(*targets))
    return b.filter(~fine).select("src", "dst", "src_role", "dst_role")


def owner_rollup(profiles: DataFrame) -> DataFrame:
    return profiles.groupBy("owner").agg(F.count(F.lit(1)).alias("repos"), F.count_if(F.col("balance") < 0).alias("risky"), F.count_if(F.col("role") == "service").alias("services"))


def snapshot_drift(latest: DataFrame, previous: DataFrame, key: str, value: str) -> DataFrame:
    """Values added to and removed from each key's set between two snapshots."""
    a = latest.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("now"))
    b = previous.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("was"))
    both = a.join(b, key)
    out = both.select(key, F.array_except("now", "was").alias("added"), F.array_except("was", "now").alias("removed"))
    return out.filter((F.size("added") > 0) | (F.size("removed") > 0))


PEEL = 2


def import_cycles(edges: DataFrame) -> DataFrame:
    """group, cycle: the cycles closed by back edges of a depth-first search in
    order of name, each rotated to begin with its least node. ``edges`` has
    group, src and dst. The order of a search is one sequence by nature, so one
    task holds the edges of one repository, but only those that can lie on a cycle:
    edges into or out of nodes without a way back or forth are peeled off first,
    ``PEEL`` layers of them."""
    for _ in range(PEEL):
        edges = edges.join(edges.select("group", F.col("src").alias("dst")).distinct(), ["group", "dst"], "left_semi")
        edges = edges.join(edges.select("group", F.col("dst").alias("src")).distinct(), ["group", "src"], "left_semi")
    edges = edges.select("group", "src", "dst")

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        graph: dict[str, list[str]] = {}
        for a, b in sorted(set(zip(rows["src"], rows["dst"], strict=True))):
            graph.setdefault(a, []).append(b)
        done, cycles = set(), set()
        for start in sorted(graph):
            if start in done:
                continue
            path, place, stack = [start], {start: 0}, [iter(graph[start])]
            while stack:
                node = next(stack[-1], None)
                if node is None:
                    stack.pop()
                    gone = path.pop()
                    del place[gone]
                    done.add(gone)
                elif node in place:
                    loop = path[place[node] :]
                    i = loop.index(min(loop))
                    cycles.add(" -> ".join([*loop[i:], *loop[:i], loop[i]]))
                elif node not in done:
                    place[node] = len(path)
                    path.append(node)
                    stack.append(iter(graph.get(node, ())))
        return pd.DataFrame({"group": [rows["group"].iloc[0]] * len(cycles), "cycle": sorted(cycles)}, dtype=object)

    return edges.groupBy("group").applyInPandas(walk, "group string, cycle string")


def _ends(arcs: DataFrame, node: str, end: str, most: int = 64) -> DataFrame:
    """node, ends: the ends of each node's arcs in lists of about ``most``, so that no node is one large row."""
    pieces = arcs.groupBy(node).agg(F.ceil(F.count(F.lit(1)) / most).alias("__n"))
    piece = F.pmod(F.xxhash64(end), F.col("__n"))
    return arcs.join(pieces, node).groupBy(node, piece.alias("__piece")).agg(F.collect_list(end).alias("ends")).select(node, "ends")


def short_cycles(edges: DataFrame) -> DataFrame:
    """Cycles of two and three nodes by joins: the form for graphs of any size."""
    e = edges.select("src", "dst").distinct()
    two = two_cycles(e).select(F.concat_ws(" -> ", "src", "dst", "src").alias("cycle"))
    # paths a, b, c meet the arcs c, a as lists: an arc is sent with the ends that follow it, not once for each
    after = _ends(e.toDF("b", "c"), "b", "c")
    before = _ends(e.toDF("c", "a").filter("a < c"), "a", "c")
    paths = e.toDF("a", "b").filter("a < b").join(after, "b").select("a", "b", F.filter("ends", lambda c: c > F.col("a")).alias("cs")).filter(F.size("cs") > 0)
    closed = paths.join(before, "a").select("a", "b", F.explode(F.array_intersect("cs", "ends")).alias("c"))
    three = closed.select(F.concat_ws(" -> ", "a", "b", "c", "a").alias("cycle"))
    return two.unionByName(three)


