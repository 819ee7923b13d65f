"""Coupling that no manifest declares: routes, hosts and topics in code, matched between owners."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from . import web
from .meet import meet

URL = r"(?i)https?://[A-Za-z0-9._:-]+(?:/[A-Za-z0-9._~:/?#\[\]@!$&'()*+,;=%-]*)?"
#: Verbs of message calls; those of the second list receive.
SENDS, RECEIVES = ("publish", "produce", "send", "emit"), ("subscribe", "consume", "listen")
TOPIC = rf"(?i)\b(?:{'|'.join(SENDS + RECEIVES)})\s*\(?\s*[\"']([A-Za-z0-9._-]{{2,120}})[\"']"
UNOWNED = "Unowned"
#: Peers and repositories that meet in one task, and the bytes of bits that it keeps at hand.
BLOCK, PART, DENSE = 1 << 18, 1 << 13, 1 << 26


def normal_route(path: Column) -> Column:
    """``/a/b`` of a path: no query or fragment, no doubled or trailing slash; ``/`` for the root."""
    plain = F.regexp_extract(F.concat(F.lit("/"), F.regexp_replace(F.trim(F.coalesce(path, F.lit(""))), "^/+", "")), r"^([^?#]*)", 1)
    short = F.regexp_replace(F.trim(plain), "/{2,}", "/")
    return F.when(short == "/", short).otherwise(F.regexp_replace(short, "/$", ""))


def api_usage(files: DataFrame, internal: tuple[str, ...] = (".local", ".internal")) -> DataFrame:
    """repo, host, route, boundary, deprecated: distinct hosts and routes of the URLs in
    ``files`` (repo, content). A route is the host with its path; null for a bare host.

    One scan of the texts, of which only matches leave the row.
    """
    url = files.select("repo", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(URL), F.lit(0)))).alias("url"))
    part = lambda i: F.regexp_extract("url", r"(?i)^https?://([^/?#]+)(.*)$", i)
    rows = url.select("repo", F.lower(F.trim(part(1))).alias("host"), normal_route(part(2)).alias("path"))
    plain = F.regexp_replace("host", r":\d+$", "")
    return rows.select(
        "repo", "host", F.when(F.col("path") != "/", F.concat("host", "path")).alias("route"), web.boundary(plain, internal).alias("boundary"),
        ((F.col("path") != "/") & F.lower(F.col("path")).rlike(web.DEPRECATED)).alias("deprecated"),
    ).distinct()


def topics(files: DataFrame) -> DataFrame:
    """repo, topic, role (produced, consumed): what message calls in ``files`` name, by their verb."""
    calls = files.select("repo", F.explode(F.regexp_extract_all("content", F.lit(TOPIC), F.lit(0))).alias("call"))
    receives = F.lower("call").rlike("|".join(RECEIVES))
    return calls.select("repo", F.regexp_extract("call", TOPIC, 1).alias("topic"), F.when(receives, "consumed").otherwise("produced").alias("role")).distinct()


def _owned(rows: DataFrame, owners: DataFrame) -> DataFrame:
    owner = F.coalesce(F.nullif(F.trim("owner"), F.lit("")), F.lit(UNOWNED))
    return rows.join(owners.select("repo", owner.alias("owner")), "repo")


def prefixes(route: Column) -> Column:
    """The route and every shorter one that ends at a slash, without the bare host."""
    parts = F.split(route, "/")
    return F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def route_matches(used: DataFrame, offered: DataFrame) -> DataFrame:
    """route, provided: for each used route the longest offered one that it begins with.

    Both (route) are distinct. The index is the used routes' prefixes, as many as a
    route has segments; each meets at most one offered route.
    """
    index = used.select("route", F.explode(prefixes(F.col("route"))).alias("provided"))
    return index.join(offered.select(F.col("route").alias("provided")).distinct(), "provided").groupBy("route").agg(F.max_by("provided", F.length("provided")).alias("provided"))


def ties(usage: DataFrame, events: DataFrame, dependencies: DataFrame, owners: DataFrame) -> DataFrame:
    """kind, item, repo, owner, peer_item, side: both ends of every possible tie, by what they meet on.

    kind is dependency, route, host or topic; side ``from`` has the repository that depends,
    uses or consumes, ``to`` the one that is depended on, provides or produces. ``usage`` and
    ``events`` are as above with only internal hosts, ``owners`` has repo, owner and
    provides (it has an API surface), ``dependencies`` repo and peer.
    """
    inside = usage.filter("boundary = 'internal'")
    offers = owners.filter("provides").select("repo")
    routes, hosts = inside.filter("route is not null").select("repo", "route").distinct(), inside.select("repo", F.col("host").alias("item")).distinct()
    offered = routes.join(offers, "repo", "left_semi")
    met = route_matches(routes.select("route").distinct(), offered)
    side = lambda rows, kind, end: rows.select(F.lit(kind).alias("kind"), "item", "repo", F.lit(end).alias("side"))
    parts = [
        side(routes.join(met, "route").select("repo", F.col("provided").alias("item")).distinct(), "route", "from"),
        side(offered.withColumnRenamed("route", "item"), "route", "to"),
        side(hosts, "host", "from"), side(hosts.join(offers, "repo", "left_semi"), "host", "to"),
        side(events.filter("role = 'consumed'").withColumnRenamed("topic", "item"), "topic", "from"),
        side(events.filter("role = 'produced'").withColumnRenamed("topic", "item"), "topic", "to"),
        side(dependencies.withColumn("item", F.col("peer")).drop("peer"), "dependency", "from"),
        side(owners.select("repo", F.col("repo").alias("item")), "dependency", "to"),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return _owned(rows, owners)


def couplings(ends: DataFrame) -> DataFrame:
    """kind, item, repo, owner, peer, peer_owner: repositories of different owners that meet on an item.
    Every pair is a row; items that very many share are spread over tasks."""
    ends = written(ends, "coupling-ends")
    a = ends.filter("side = 'from'").drop("side")
    b = ends.filter("side = 'to'").select("kind", "item", F.col("repo").alias("peer"), F.col("owner").alias("peer_owner"))
    return meet(a, b, ["kind", "item"]).filter("owner <> peer_owner")


def team_flows(ends: DataFrame) -> DataFrame:
    """kind, source, target, n: how many couplings join each two owners. Topics flow from
    the producer, all else from the one that depends. Ends are counted by item and
    owner before they meet, so an item that very many share is no product of repositories."""
    n = ends.groupBy("kind", "item", "side", "owner").agg(F.count(F.lit(1)).alias("n"))
    a = n.filter("side = 'from'").select("kind", "item", F.col("owner").alias("a"), F.col("n").alias("na"))
    b = n.filter("side = 'to'").select("kind", "item", F.col("owner").alias("b"), F.col("n").alias("nb"))
    topic = F.col("kind") == "topic"
    met = a.join(b, ["kind", "item"]).filter("a <> b")
    return met.groupBy("kind", F.when(topic, F.col("b")).otherwise(F.col("a")).alias("source"), F.when(topic, F.col("a")).otherwise(F.col("b")).alias("target")).agg(F.sum(F.col("na") * F.col("nb")).alias("n"))


def _peers():
    """What a task does; nested, so that executors need no module of this package."""

    def counted(table: pa.Table) -> pa.Table:
        """The peers of the ``left`` rows among the others, a bit each: by sort of item and all."""
        left = table.column("left").to_numpy()
        lists = table.column("ids").combine_chunks()
        ends = lists.offsets.to_numpy()
        ids = lists.values.to_numpy()[ends[0] : ends[-1]]
        sorts = table.column("sorts").combine_chunks()
        sorts = sorts.values.to_numpy()[sorts.offsets[0].as_py() : sorts.offsets[-1].as_py()]
        ends = ends - ends[0]
        right = np.flatnonzero(~left)
        place = np.full(len(left), -1)
        place[right] = np.arange(len(right))
        words = -(-len(right) // 64)
        known, code = np.unique(ids, return_inverse=True)
        at = place[np.repeat(np.arange(len(left)), np.diff(ends))]
        code_r, at = code[at >= 0], at[at >= 0]
        by = np.argsort(code_r, kind="stable")
        at, first = at[by], np.searchsorted(code_r[by], np.arange(len(known) + 1))

        def plane(places: np.ndarray) -> np.ndarray:
            out = np.zeros(words, np.uint64)
            np.bitwise_or.at(out, places >> 6, np.left_shift(np.uint64(1), (places & 63).astype(np.uint64)))
            return out

        df = np.diff(first)
        common = np.argsort(-df, kind="stable")[: max(DENSE // (8 * max(words, 1)), 1)]
        dense = {t: plane(at[first[t] : first[t + 1]]) for t in common[df[common] > 32].tolist()}
        repos, owners = table.column("repo").to_pylist(), table.column("owner").to_pylist()
        of_owner = {}
        for p, r in enumerate(right.tolist()):
            of_owner.setdefault(owners[r], []).append(p)
        others = {o: ~plane(np.array(of_owner.get(o, []), np.int64)) for o in {owners[r] for r in np.flatnonzero(left).tolist()}}
        count, out = {}, []
        for row in np.flatnonzero(left).tolist():
            mine, n, every = others[owners[row]], [0, 0, 0], np.zeros(words, np.uint64)
            for t, s in zip(code[ends[row] : ends[row + 1]].tolist(), sorts[ends[row] : ends[row + 1]].tolist(), strict=True):
                x = dense[t] if t in dense else plane(at[first[t] : first[t + 1]]) if df[t] else None
                if x is not None:
                    np.bitwise_or(every, x, out=every)
                    if (t, owners[row]) not in count:
                        count[t, owners[row]] = int(np.bitwise_count(x & mine).sum())
                    n[s] += count[t, owners[row]]
            if any(n):
                out.append((repos[row], owners[row], *n, int(np.bitwise_count(every & mine).sum())))
        columns = list(zip(*out, strict=True)) or [[]] * 6
        types = [pa.string(), pa.string(), *[pa.int64()] * 4]
        return pa.table({c: pa.array(v, t) for c, v, t in zip(("repo", "owner", "dependencies", "api", "events", "peers"), columns, types, strict=True)})

    return counted


def hidden_coupling(ends: DataFrame, most: int = 8, block: int = BLOCK, part: int = PART) -> DataFrame:
    """repo, owner, dependencies, api, events, peers, coupling: each repository's couplings of
    every sort, and their number with at most ``most`` of a sort counted.

    No coupling is listed: ``part`` repositories that depend meet ``block`` others in a task, where
    those that share an item are a row of bits; bits are united and counted. A route has a
    slash and a host none, so an item and a peer are one coupling at most.
    """
    ends = written(ends.distinct(), "coupling-ends")
    is_from = F.col("side") == "from"
    items = ends.groupBy("kind", "item").agg(F.bool_or(is_from).alias("f"), F.bool_or(~is_from).alias("t")).filter("f and t").select("kind", "item")
    items = written(items.withColumn("id", F.monotonically_increasing_id()), "coupling-items")
    sort = F.when(F.col("kind") == "topic", 2).when(F.col("kind") == "dependency", 0).otherwise(1)
    rows = ends.join(items, ["kind", "item"]).select("repo", "owner", "side", F.struct("id", sort.alias("sort")).alias("x"))
    a = rows.filter(is_from).groupBy("repo", "owner").agg(F.collect_set("x").alias("x"))
    # a repository has the same owners at all its ends; of several, one is another's for everybody
    b = rows.filter(~is_from).groupBy("repo").agg(F.when(F.min("owner") == F.max("owner"), F.min("owner")).alias("owner"), F.collect_set("x").alias("x"))
    shown = lambda df, left: written(df.select("repo", "owner", F.lit(left).alias("left"), F.col("x.id").alias("ids"), F.col("x.sort").alias("sorts")), "coupling-lists")
    a, b = shown(a, True), shown(b, False)
    parts, blocks = max(1, -(-a.count() // part)), max(1, -(-b.count() // block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    of = lambda n: F.pmod(F.xxhash64("repo"), F.lit(n)).cast("int")
    a = a.select("*", every(blocks).alias("o")).withColumn("task", F.col("o") * parts + of(parts)).drop("o")
    b = b.select("*", every(parts).alias("o")).withColumn("task", of(blocks) * parts + F.col("o")).drop("o")
    met = a.unionByName(b).repartitionById(blocks * parts, F.col("task")).groupBy("task").applyInArrow(_peers(), "repo string, owner string, dependencies long, api long, events long, peers long")
    pairs = met.groupBy("repo", "owner").agg(*[F.sum(c).alias(c) for c in ("dependencies", "api", "events", "peers")])
    return pairs.withColumn("coupling", sum((F.least(c, F.lit(most)) for c in ("api", "events")), F.least("dependencies", F.lit(most))))
