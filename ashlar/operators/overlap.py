"""Overlap of repositories: points for what two share, pairs of many points found by their rare tags.

Each kind of tag gives a point a shared tag up to a cap. Repositories of equal tags are
one class. Of a class, the commonest tags that together can't reach the least score
are left out of the index: two classes that reach it share a tag of what is left of
both, as the rarest tag that they share can't lie among those left out. Classes meet
on these tags alone, and only such pairs are scored.

Counts of pairs need no list of them (``overlap_counts``): blocks of classes meet as bits,
a bit a class, and tasks add up shared tags for 64 classes at once. What leaves a task are
counts by class and score, so the number of pairs is no size of any table.
"""

from __future__ import annotations

from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import written

#: kind: (column, cap of its points, label, tags that a label shows)
KINDS = {
    "tech": ("technologies", 2, "stack", 3),
    "runtime": ("runtimes", 1, None, 0),
    "api": ("api_types", 1, "API patterns", 2),
    "event": ("event_systems", 1, "event systems", 2),
    "lib": ("internal_dependency_names", 2, "internal libraries", 3),
    "module": ("module_markers", 2, "module markers", 4),
}
LEAST = 4
#: Classes of a block and how many parts a block is cut to where it meets another.
BLOCK, PARTS = 1 << 18, 4
_DENSE = 1 << 26


def classes(repos: DataFrame, key: str = "repo", kinds: dict = KINDS) -> DataFrame:
    """rep, n and the sorted tags of each kind: one row for all repositories that have equal tags."""
    cols = [c for c, *_ in kinds.values()]
    tags = [F.array_sort(F.array_distinct(F.coalesce(F.col(c), F.array().cast("array<string>")))).alias(c) for c in cols]
    return repos.select(key, *tags).groupBy(*cols).agg(F.min(key).alias("rep"), F.count(F.lit(1)).alias("n"))


def _points(shared: dict[str, Column], kinds: dict) -> Column:
    return sum((F.least(F.size(shared[k]), F.lit(cap)) for k, (_, cap, *_) in kinds.items()), F.lit(0))


def indexed(sets: DataFrame, least: int, kinds: dict) -> DataFrame:
    """rep, kind, tag: the tags on which classes must meet."""
    tags = F.array(*[F.transform(c, (lambda k: lambda t: F.struct(F.lit(k).alias("kind"), t.alias("tag")))(k)) for k, (c, *_) in kinds.items()])
    rows = sets.select("rep", F.explode(F.flatten(tags)).alias("x")).select("rep", "x.*")
    rows = rows.join(rows.groupBy("kind", "tag").agg(F.count(F.lit(1)).alias("df")), ["kind", "tag"])
    common = [F.desc("df"), "kind", "tag"]
    cap = F.create_map(*[F.lit(x) for k, (_, cap, *_) in kinds.items() for x in (k, cap)])[F.col("kind")]
    counts = (F.row_number().over(W.partitionBy("rep", "kind").orderBy(*common)) <= cap).cast("int")  # windows over one class's tags
    reach = F.sum("counts").over(W.partitionBy("rep").orderBy(*common).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("counts", counts).withColumn("reach", reach).filter(F.col("reach") >= least).select("rep", "kind", "tag")


def class_overlaps(sets: DataFrame, least: int = LEAST, kinds: dict = KINDS) -> DataFrame:
    """a, b, score, pairs, reasons, modules: classes (``classes``) whose score is ``least`` or more.

    ``pairs`` is the number of repository pairs they stand for; a class with itself
    stands for its own. ``reasons`` tell what is shared, ``modules`` the shared markers.
    """
    cols = [c for c, *_ in kinds.values()]
    index = indexed(sets, least, kinds)
    other = index.select(F.col("rep").alias("other"), "kind", "tag")
    met = index.join(other, ["kind", "tag"]).filter("rep < other").select(F.col("rep").alias("a"), F.col("other").alias("b")).distinct()
    left = sets.select(F.col("rep").alias("a"), F.col("n").alias("na"), *[F.col(c).alias(f"{c}_a") for c in cols])
    right = sets.select(F.col("rep").alias("b"), F.col("n").alias("nb"), *[F.col(c).alias(f"{c}_b") for c in cols])
    both = met.join(left, "a").join(right, "b")
    selves = left.join(right, F.col("a") == F.col("b")).filter("na > 1").select(*both.columns)
    both = both.unionByName(selves)
    both = both.select("a", "b", "na", "nb", *[F.array_sort(F.array_intersect(f"{c}_a", f"{c}_b")).alias(c) for c in cols])
    shared = {k: F.col(c) for k, (c, *_) in kinds.items()}
    pairs = F.when(F.col("a") == F.col("b"), F.floor(F.col("na") * (F.col("na") - 1) / 2)).otherwise(F.col("na") * F.col("nb")).cast("long")
    shown = lambda c, label, most: F.when(F.size(c) > 0, F.concat(F.lit(f"{label}: "), F.array_join(F.slice(c, 1, most), ", ")))
    reasons = F.array_compact(F.array(*[shown(F.col(c), label, most) for c, _, label, most in kinds.values() if label]))
    return both.withColumn("score", _points(shared, kinds)).filter(F.col("score") >= least).select("a", "b", "score", pairs.alias("pairs"), reasons.alias("reasons"), F.col(kinds["module"][0]).alias("modules") if "module" in kinds else F.array().alias("modules"))


def repo_overlaps(repos: DataFrame, found: DataFrame, key: str = "repo", kinds: dict = KINDS) -> DataFrame:
    """repo, overlap_score, peers: the best score of each repository that overlaps, and how
    many others it overlaps with, from its class's pairs."""
    sets = classes(repos, key, kinds)
    ends = F.explode(F.array(F.struct(F.col("a").alias("rep"), F.col("b").alias("peer")), F.struct(F.col("b").alias("rep"), F.col("a").alias("peer"))))
    links = found.select("score", ends.alias("e")).select("score", "e.*").distinct()
    size = sets.select(F.col("rep").alias("peer"), "n")
    per = links.join(size, "peer").groupBy("rep").agg(F.max("score").alias("overlap_score"), F.sum(F.col("n") - (F.col("rep") == F.col("peer")).cast("int")).alias("peers"))
    cols = [c for c, *_ in kinds.values()]
    tags = [F.array_sort(F.array_distinct(F.coalesce(F.col(c), F.array().cast("array<string>")))).alias(c) for c in cols]
    return repos.select(key, *tags).join(sets.join(per, "rep").select(*cols, "overlap_score", "peers"), cols).select(key, "overlap_score", "peers")


def duplicate_modules(found: DataFrame, most: int = 6) -> DataFrame:
    """module, n: in how many overlapping pairs a marker is among the first ``most`` shared."""
    return found.select(F.explode(F.slice("modules", 1, most)).alias("module"), "pairs").groupBy("module").agg(F.sum("pairs").alias("n"))


def _coded(sets: DataFrame, kinds: dict) -> DataFrame:
    """cid, rep, n, kind, tag: classes with their tags as numbers, by kind and in order of the names."""
    sets = written(sets.withColumn("cid", F.monotonically_increasing_id()), "overlap-classes")
    each = F.flatten(F.array(*[F.transform(c, (lambda k: lambda t, i: F.struct(F.lit(k).alias("kind"), i.alias("at"), t.alias("tag")))(k)) for k, (c, *_) in enumerate(kinds.values())]))
    rows = sets.select("cid", F.explode(each).alias("x")).select("cid", "x.*").filter("tag is not null")
    names = written(rows.select("kind", "tag").distinct().withColumn("id", F.monotonically_increasing_id()), "overlap-tags")
    lists = rows.join(names, ["kind", "tag"]).groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("kind", "at", "id"))).alias("x"))
    lists = lists.select("cid", F.col("x.kind").alias("kind"), F.col("x.id").alias("tag"))
    return sets.select("cid", "rep", "n").join(lists, "cid"), names


def _counts(caps: list[int], least: int, module: int, most: int = 0, by_module: bool = False):
    """What a task does; nested, so that executors need no module of this package."""

    def counter(bits: list, x: np.ndarray, spare: np.ndarray, added: int) -> None:
        """Adds the bits ``x`` to counters whose binary digits are ``bits``; ``added`` were added before."""
        for level, digit in enumerate(bits):
            if (added + 1) >> level == 0:
                break
            carry = np.bitwise_and(digit, x, out=spare[level])
            np.bitwise_xor(digit, x, out=digit)
            x = carry

    def counted(table: pa.Table) -> pa.Table:
        """Counts of a part of one block (``left``) against the classes of a block, pairs from either end."""
        cid, n, left = (table.column(c).to_numpy() for c in ("cid", "n", "left"))
        lists = [table.column(c).combine_chunks() for c in ("kind", "tag")]
        ends = lists[0].offsets.to_numpy()
        kinds, tags = (x.values.to_numpy()[ends[0] : ends[-1]] for x in lists)
        ends = ends - ends[0]
        size = np.diff(ends)
        owner = np.repeat(np.arange(len(cid)), size)
        right = np.flatnonzero(~left)
        order = right[np.argsort(cid[right])]
        words = -(-len(order) // 64)
        place = np.full(len(cid), -1)
        place[order] = np.arange(len(order))
        known, code = np.unique(tags, return_inverse=True)
        of_right = place[owner] >= 0
        code_r, at_r = code[of_right], place[owner[of_right]]
        by = np.argsort(code_r, kind="stable")
        at_r = at_r[by]
        first = np.searchsorted(code_r[by], np.arange(len(known) + 1))
        bit = lambda at: np.left_shift(np.uint64(1), (at & 63).astype(np.uint64))

        def plane(at: np.ndarray, out: np.ndarray) -> np.ndarray:
            out[:] = 0
            np.bitwise_or.at(out, at >> 6, bit(at))
            return out

        df = np.diff(first)
        common = np.argsort(-df, kind="stable")[: max(_DENSE // (8 * max(words, 1)), 1)]
        dense = {t: plane(at_r[first[t] : first[t + 1]], np.empty(words, np.uint64)) for t in common[df[common] > 32].tolist()}
        weights = n[order]
        n_bits = sum(caps).bit_length()
        score, spare, found = np.empty((n_bits, words), np.uint64), np.empty((n_bits, words), np.uint64), np.empty(words, np.uint64)
        levels, single, held = np.empty((max(caps), words), np.uint64), np.empty(words, np.uint64), np.empty(words, np.uint64)
        sums = list(score)
        own = {c: p for c, p in zip(cid[order].tolist(), range(len(order)), strict=True)}

        def bits_of(t: int):
            """The right classes that have a tag; None for none."""
            if t in dense:
                return dense[t]
            return plane(at_r[first[t] : first[t + 1]], single) if df[t] else None

        out = Counter()
        for row in np.flatnonzero(left).tolist():
            mine = list(zip(kinds[ends[row] : ends[row + 1]].tolist(), code[ends[row] : ends[row + 1]].tolist(), strict=True))
            score[:] = 0
            added = 0
            for k, of_kind in groupby(mine, lambda x: x[0]):
                seen = 0
                for _, t in of_kind:
                    x = bits_of(t)
                    if x is None:
                        continue
                    for j in range(min(seen, caps[k] - 1), 0, -1):  # at least j + 1 of the kind
                        np.bitwise_and(levels[j - 1], x, out=held)
                        if j < seen:
                            np.bitwise_or(levels[j], held, out=levels[j])
                        else:
                            levels[j] = held
                    if seen:
                        np.bitwise_or(levels[0], x, out=levels[0])
                    else:
                        levels[0] = x
                    seen += 1
                for j in range(min(seen, caps[k])):
                    counter(sums, levels[j], spare, added)
                    added += 1
            who, modules = cid[row], [t for k, t in mine if k == module]
            best = Counter(k for k, _ in mine)
            best = sum(min(v, caps[k]) for k, v in best.items())
            if who in own and n[row] > 1 and best >= least:  # a class with itself
                for at, t in enumerate(modules if by_module else [None]):
                    if t is None:
                        out[row, best, len(modules)] += int(n[row]) - 1
                    elif at < most:
                        out[t] += int(n[row]) * (int(n[row]) - 1)
            if added < least:
                continue
            # at least ``least``: from the highest digit down, equal so far or above
            above, equal = np.zeros(words, np.uint64), None
            for j in range(n_bits - 1, -1, -1):
                if least >> j & 1:
                    equal = score[j].copy() if equal is None else equal & score[j]
                else:
                    above |= score[j] if equal is None else equal & score[j]
            np.bitwise_or(above, equal if equal is not None else ~np.uint64(0), out=found)
            if who in own:
                found[own[who] >> 6] &= ~bit(np.array([own[who]]))[0]
            if len(order) % 64:
                found[-1] &= np.uint64((1 << len(order) % 64) - 1)
            kept = np.flatnonzero(found)
            if not len(kept):
                continue
            pairs = np.flatnonzero(np.unpackbits(found[kept].view(np.uint8), bitorder="little"))
            word, shift = kept[pairs >> 6], (pairs & 63).astype(np.uint64)
            weight = weights[(word << 6) + (pairs & 63)]
            set_in = lambda plane_: (plane_[word] >> shift & np.uint64(1)).astype(np.int64)  # noqa: E731, B023
            shared = np.zeros(len(pairs), np.int64)
            for t in modules:
                x = bits_of(t)
                if x is not None:
                    x = set_in(x)
                    if by_module:
                        out[t] += int(n[row]) * int((weight * x)[shared < most].sum())
                    shared += x
            if not by_module:
                total = sum(set_in(d) << j for j, d in enumerate(sums))
                cell = total * (len(modules) + 1) + shared
                for v in np.flatnonzero(np.bincount(cell)).tolist():
                    out[row, v // (len(modules) + 1), v % (len(modules) + 1)] += int(weight[cell == v].sum())
        if by_module:
            return pa.table({"id": pa.array([int(known[t]) for t in out], pa.int64()), "pairs": pa.array(list(out.values()), pa.int64())})
        rows = list(out)
        return pa.table({
            "cid": pa.array([int(cid[r]) for r, _, _ in rows], pa.int64()), "score": pa.array([v for _, v, _ in rows], pa.int32()),
            "modules": pa.array([m for _, _, m in rows], pa.int32()), "peers": pa.array(list(out.values()), pa.int64()),
        })

    return counted


def _met(coded: DataFrame, block: int, parts: int) -> DataFrame:
    """cid, n, kind, tag, left, task: every part of a block beside every block, a task each."""
    blocks = max(1, -(-coded.count() // block))
    rows = coded.select("cid", "n", "kind", "tag", F.pmod(F.xxhash64("cid"), F.lit(blocks)).cast("int").alias("b"), F.pmod(F.xxhash64("cid", F.lit(1)), F.lit(parts)).cast("int").alias("p"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    right = rows.select("*", every(blocks * parts).alias("part")).select("cid", "n", "kind", "tag", F.lit(False).alias("left"), (F.col("b") * (blocks * parts) + F.col("part")).alias("task"))
    left = rows.select("*", every(blocks).alias("other")).select("cid", "n", "kind", "tag", F.lit(True).alias("left"), (F.col("other") * (blocks * parts) + F.col("b") * parts + F.col("p")).alias("task"))
    return right.unionByName(left).repartitionById(blocks * blocks * parts, F.col("task"))


def overlap_counts(sets: DataFrame, least: int = LEAST, kinds: dict = KINDS, block: int = BLOCK, parts: int = PARTS) -> DataFrame:
    """rep, n, score, modules, peers: of each class (``classes``) how many repositories
    each of its members overlaps with, by score and number of shared markers. Exact, and no pair is listed."""
    coded, _ = _coded(sets, kinds)
    coded = written(coded, "overlap-coded")
    caps, module = [cap for _, cap, *_ in kinds.values()], list(kinds).index("module") if "module" in kinds else -1
    made = _met(coded, block, parts).groupBy("task").applyInArrow(_counts(caps, least, module), "cid long, score int, modules int, peers long")
    made = made.groupBy("cid", "score", "modules").agg(F.sum("peers").alias("peers"))
    return made.join(coded.select("cid", "rep", "n"), "cid").select("rep", "n", "score", "modules", "peers")


def module_counts(sets: DataFrame, least: int = LEAST, kinds: dict = KINDS, most: int = 6, block: int = BLOCK, parts: int = PARTS) -> DataFrame:
    """module, n: as ``duplicate_modules`` has them, without a list of pairs."""
    coded, names = _coded(sets, kinds)
    coded = written(coded, "overlap-coded")
    caps, module = [cap for _, cap, *_ in kinds.values()], list(kinds).index("module")
    made = _met(coded, block, parts).groupBy("task").applyInArrow(_counts(caps, least, module, most, True), "id long, pairs long")
    made = made.groupBy("id").agg(F.floor(F.sum("pairs") / 2).cast("long").alias("n")).filter("n > 0")
    return made.join(names, "id").select(F.col("tag").alias("module"), "n")


def repo_risk(repos: DataFrame, least: int = LEAST, key: str = "repo", kinds: dict = KINDS, block: int = BLOCK, parts: int = PARTS) -> DataFrame:
    """repo, overlap_score, peers: as ``repo_overlaps`` has them, without a list of pairs."""
    sets = written(classes(repos, key, kinds), "overlap-sets")
    per = overlap_counts(sets, least, kinds, block, parts).groupBy("rep").agg(F.max("score").alias("overlap_score"), F.sum("peers").alias("peers"))
    cols = [c for c, *_ in kinds.values()]
    tags = [F.array_sort(F.array_distinct(F.coalesce(F.col(c), F.array().cast("array<string>")))).alias(c) for c in cols]
    return repos.select(key, *tags).join(sets.join(per, "rep").select(*cols, "overlap_score", "peers"), cols).select(key, "overlap_score", "peers")
