"""Couplings in code and overlaps of repositories against plain Python over all pairs."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ashlar.operators import coupling, overlap


def test_routes_and_topics_from_code(spark):
    text = "get('HTTPS://Api.local:8080//a//b/?q=1#f') http://x.com http://x.com/ https://h.internal/v1/old/\nbus.Publish('t.one') listen \"t-two\" resubscribe('no') SEND ( 'x'"
    files = spark.createDataFrame([("r", text), ("r", None), ("s", "")], "repo string, content string")
    got = {tuple(r)[1:] for r in coupling.api_usage(files).collect()}
    assert got == {
        ("api.local:8080", "api.local:8080/a/b", "internal", False), ("x.com", None, "external", False), ("h.internal", "h.internal/v1/old", "internal", True),
    }
    assert {tuple(r) for r in coupling.topics(files).collect()} == {("r", "t.one", "produced"), ("r", "t-two", "consumed")}
    routes = {"": "/", None: "/", "a/": "/a", "/a//b/?x": "/a/b", " /q#z": "/q", "//": "/", "?x": "/"}
    df = spark.createDataFrame([(k,) for k in routes], "p string").select("p", coupling.normal_route(F.col("p")).alias("r"))
    assert {r["p"]: r["r"] for r in df.collect()} == routes


def test_couplings_equal_all_pairs(spark):
    rng = random.Random(2)
    repos = [f"r{i}" for i in range(60)]
    owner = {r: rng.choice(["a", "b", "c", "", None, " a "]) for r in repos}
    named = {r: (o or "").strip() or "Unowned" for r, o in owner.items()}
    provides = {r: rng.random() < 0.4 for r in repos}
    route = lambda: "h" + str(rng.randrange(3)) + ".local" + "".join(f"/{rng.choice('xyz')}" for _ in range(rng.randint(0, 4)))
    used = {(r, route()) for r in repos for _ in range(3)}
    said = {(r, f"t{rng.randrange(9)}", rng.choice(["produced", "consumed"])) for r in repos}
    needs = {(r, rng.choice([*repos, "gone"])) for r in repos}
    split = lambda u: (u.split("/")[0], u if "/" in u else None)
    usage = spark.createDataFrame([(r, *split(u), "internal", False) for r, u in used] + [("r0", "out.com", "out.com/x", "external", False)], "repo string, host string, route string, boundary string, deprecated boolean")
    owners = spark.createDataFrame([(r, owner[r], provides[r]) for r in repos], "repo string, owner string, provides boolean")
    ends = coupling.ties(usage, spark.createDataFrame(list(said), "repo string, topic string, role string"), spark.createDataFrame(list(needs), "repo string, peer string"), owners)
    offered = {u for r, u in used if provides[r] and "/" in u}
    want = set()
    for r, u in used:
        fits = [o for o in offered if "/" in u and (u == o or u.startswith(o + "/"))]
        if fits:
            best = max(fits, key=len)
            want |= {("route", best, r, p) for p, x in used if x == best and provides[p]}
        want |= {("host", u.split("/")[0], r, p) for p, x in used if provides[p] and x.split("/")[0] == u.split("/")[0]}
    want |= {("topic", t, r, p) for r, t, x in said if x == "consumed" for p, s, y in said if s == t and y == "produced"}
    want |= {("dependency", p, r, p) for r, p in needs if p in named}
    want = {(k, i, r, named[r], p, named[p]) for k, i, r, p in want if named[r] != named[p]}
    assert {tuple(x[c] for c in ("kind", "item", "repo", "owner", "peer", "peer_owner")) for x in coupling.couplings(ends).collect()} == want
    flows = Counter((k, *((po, o) if k == "topic" else (o, po))) for k, _, _, o, _, po in want)
    assert {(r["kind"], r["source"], r["target"]): r["n"] for r in coupling.team_flows(ends).collect()} == dict(flows)
    for r in coupling.hidden_coupling(ends, 2).collect():
        mine = {("events" if k == "topic" else "dependencies" if k == "dependency" else "api", i, p) for k, i, x, _, p, _ in want if x == r["repo"]}
        n = Counter(s for s, _, _ in mine)
        assert (r["dependencies"], r["api"], r["events"]) == (n["dependencies"], n["api"], n["events"])
        assert r["coupling"] == sum(min(v, 2) for v in n.values()) and r["peers"] == len({p for _, _, p in mine})


def test_hidden_coupling_lists_no_pair(spark):
    rng = random.Random(5)
    owners = {f"r{i}": {rng.choice("abc")} | ({"d"} if i % 9 == 0 else set()) for i in range(90)}
    rows = {(kind, item, r, o, side) for r, os in owners.items() for kind in ("topic", "host", "route", "dependency") for side in ("from", "to") if rng.random() < 0.4 for item in [f"{kind}{rng.randrange(4)}"] for o in os}
    ends = spark.createDataFrame(list(rows), "kind string, item string, repo string, owner string, side string")
    want = {}
    for k, i, r, o, side in rows:
        peers = {(p, i) for k2, i2, p, o2, s2 in rows if (k2, i2, s2) == (k, i, "to") and o2 != o}
        if side == "from" and peers:
            want.setdefault((r, o), []).extend(("events" if k == "topic" else "dependencies" if k == "dependency" else "api", p) for p, _ in peers)
    got = coupling.hidden_coupling(ends, 3, block=20, part=30)
    n = {key: Counter(s for s, _ in v) for key, v in want.items()}
    assert {(r["repo"], r["owner"]): (r["dependencies"], r["api"], r["events"], r["peers"], r["coupling"]) for r in got.collect()} == {
        key: (n[key]["dependencies"], n[key]["api"], n[key]["events"], len({p for _, p in v}), sum(min(x, 3) for x in n[key].values())) for key, v in want.items()
    }
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()  # ends met in pairs before


def test_couplings_of_one_item_spread_over_tasks(spark):
    rows = [("topic", "t", f"r{i}", "ab"[i % 2], side) for i in range(6000) for side in (["from", "to"] if i % 3 else ["from"])]
    met = coupling.couplings(spark.createDataFrame(rows, "kind string, item string, repo string, owner string, side string"))
    parts = [r["n"] for r in met.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(parts) == 2 * 3000 * 2000 and max(parts) < 0.75 * sum(parts)


COLS = [c for c, *_ in overlap.KINDS.values()]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_overlaps_equal_all_pairs(spark, seed):
    rng = random.Random(seed)
    sizes = [6, 3, 3, 4, 8, 12]
    pool = [[tuple(sorted(rng.sample([f"{c[0]}{j}" for j in range(n)], rng.randint(0, 3)))) for _ in range(9)] for c, n in zip(COLS, sizes, strict=True)]
    repos = {f"r{i:03}": [rng.choice(p) for p in pool] for i in range(200)}
    repos |= {f"s{i}": repos["r001"] for i in range(20)}  # many of equal tags
    rows = [(r, *[list(x) if x or rng.random() < 0.5 else None for x in tags]) for r, tags in repos.items()]
    df = spark.createDataFrame(rows, "repo string, " + ", ".join(f"{c} array<string>" for c in COLS))
    caps = [cap for _, cap, *_ in overlap.KINDS.values()]
    want = {}
    names = sorted(repos)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            shared = [set(x) & set(y) for x, y in zip(repos[a], repos[b], strict=True)]
            score = sum(min(len(s), cap) for s, cap in zip(shared, caps, strict=True))
            if score >= overlap.LEAST:
                want[a, b] = score, tuple(sorted(shared[5]))
    sets = overlap.classes(df)
    found = overlap.class_overlaps(sets)
    by_class = {tuple(map(tuple, tags)): [] for tags in repos.values()}
    for r in names:
        by_class[tuple(map(tuple, repos[r]))].append(r)
    members = {min(v): v for v in by_class.values()}
    got = {}
    for r in found.collect():
        pairs = {tuple(sorted((x, y))) for x in members[r["a"]] for y in members[r["b"]] if x != y}
        assert r["pairs"] == len(pairs)
        for p in pairs:
            assert p not in got
            got[p] = r["score"], tuple(r["modules"])
    assert got == want and len(want) > 100
    per = {r["repo"]: (r["overlap_score"], r["peers"]) for r in overlap.repo_overlaps(df, found).collect()}
    for r in names:
        mine = [s for p, (s, _) in want.items() if r in p]
        assert per.get(r) == ((max(mine), len(mine)) if mine else None)
    counts = Counter(m for _, ms in want.values() for m in ms[:6])
    assert {r["module"]: r["n"] for r in overlap.duplicate_modules(found).collect()} == dict(counts)
    common = overlap.indexed(sets, overlap.LEAST, overlap.KINDS).count()
    every = sets.select(sum((F.size(c) for c in COLS), F.lit(0)).alias("n")).agg(F.sum("n")).first()[0]
    assert common < every  # the commonest tags are not met on


@pytest.mark.parametrize(("least", "most", "block"), [(4, 6, 70), (2, 1, 1 << 18), (5, 2, 40)])
def test_counts_equal_listed_pairs(spark, least, most, block):
    rng = random.Random(least)
    sizes = [6, 3, 3, 4, 8, 12]
    tags = lambda c, n: tuple(sorted(rng.sample([f"{c[0]}{j}" for j in range(n)], rng.randint(0, 3))))
    repos = {f"r{i:03}": [tags(c, n) for c, n in zip(COLS, sizes, strict=True)] for i in range(150)}
    repos |= {f"s{i}": repos["r001"] for i in range(20)} | {"t": repos["r002"], "none": [()] * 6}
    df = spark.createDataFrame([(r, *map(list, x)) for r, x in repos.items()], "repo string, " + ", ".join(f"{c} array<string>" for c in COLS))
    caps = [cap for _, cap, *_ in overlap.KINDS.values()]
    want, risk, named = Counter(), {}, Counter()
    for a, x in repos.items():
        for b, y in repos.items():
            shared = [sorted(set(p) & set(q)) for p, q in zip(x, y, strict=True)]
            score = sum(min(len(s), cap) for s, cap in zip(shared, caps, strict=True))
            if a != b and score >= least:
                want[score, len(shared[5])] += 1
                risk[a] = max(score, risk.get(a, (0, 0))[0]), risk.get(a, (0, 0))[1] + 1
                named.update(shared[5][:most] if a < b else [])
    sets = overlap.classes(df)
    got = Counter()
    for r in overlap.overlap_counts(sets, least, block=block, parts=2).collect():
        got[r["score"], r["modules"]] += r["n"] * r["peers"]
    assert got == want
    assert {r["repo"]: (r["overlap_score"], r["peers"]) for r in overlap.repo_risk(df, least, block=block, parts=2).collect()} == risk
    assert {r["module"]: r["n"] for r in overlap.module_counts(sets, least, most=most, block=block, parts=2).collect()} == named


def test_flows_by_regex_stay_in_the_row(spark):
    plan = coupling.topics(spark.createDataFrame([("r", "x")], "repo string, content string"))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and re.search("Generate", plan)
