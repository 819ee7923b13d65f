"""The template tree against a plain recursive one, and sites with variable segments."""

import random
from collections import defaultdict

import pytest

from ashlar.llm import urls


def plain_templates(paths):
    """{(host, typed): template} of {(host, typed): (n, lab, bad)}, node by node."""
    out = {}

    def descend(host, rows, prefix, level):
        kids = defaultdict(list)
        for typed in rows:
            segs = typed.split("/")
            if len(segs) == level:
                out[host, typed] = prefix
            else:
                kids[segs[level]].append(typed)
        if not kids:
            return
        sums = {k: [sum(paths[host, t][i] for t in v) for i in range(3)] for k, v in kids.items()}
        name = {k: k for k in kids}
        if len(kids) >= urls.VARIABLE_CHILDREN and sum(s[0] for s in sums.values()) < len(kids) * urls.VARIABLE_MEAN:
            name = dict.fromkeys(kids, "*")
        else:
            shares = defaultdict(list)
            for k, (_, lab, bad) in sums.items():
                if lab:
                    shares[bad * urls.SHARES // lab].append(k)
            runs, last = [], None
            for s in sorted(shares):
                lab, bad = (sum(sums[k][i] for k in shares[s]) for i in (1, 2))
                if last:
                    p = (bad + last[1]) / (lab + last[0])
                    if abs(bad / lab - last[1] / last[0]) > urls.MERGE_Z * (p * (1 - p) * (1 / lab + 1 / last[0])) ** 0.5:
                        runs.append([])
                runs = runs or [[]]
                runs[-1] += shares[s]
                last = lab, bad
            for i, run in enumerate(runs):
                if len(run) > 1:
                    name |= dict.fromkeys(run, f"~{i}")
        groups = defaultdict(list)
        for k, v in kids.items():
            groups[name[k]] += v
        for g, v in groups.items():
            descend(host, v, f"{prefix}/{g}" if level else g, level + 1)

    by_host = defaultdict(list)
    for host, typed in paths:
        by_host[host].append(typed)
    for host, rows in by_host.items():
        descend(host, rows, "", 0)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_tree_equals_plain_recursion(spark, seed):
    rng = random.Random(seed)
    paths = {}
    for _ in range(600):
        depth = rng.randint(1, 5)
        segs = [rng.choice("ab") if rng.random() < 0.4 else f"s{rng.randrange(rng.choice([4, 60]))}" for _ in range(depth)]
        host = rng.choice("hgv")
        if host == "v":
            segs[0] = f"u{rng.randrange(500)}"
        n = 1 if host == "v" else rng.choice([1, 1, 1, 2, 9])
        lab = rng.choice([n, n, rng.randint(0, n)])
        bad = lab if "a" in segs and rng.random() < 0.8 else rng.randint(0, lab) if rng.random() < 0.2 else 0
        paths[host, "/".join(segs)] = n, lab, bad
    df = spark.createDataFrame([(h, t, *v) for (h, t), v in paths.items()], "host string, typed string, n long, lab long, bad long")
    got = {(r["host"], r["typed"]): r["template"] for r in urls.templates(df).collect()}
    want = plain_templates(paths)
    assert got == want
    assert any("*/" in t for t in want.values()) and any("~" in t for t in want.values())
    labelled = spark.createDataFrame([(h, t, 1 if i < bad else 0 if i < lab else None) for (h, t), (n, lab, bad) in paths.items() for i in range(n)], "host string, typed string, bad int")
    sums = defaultdict(lambda: [0, 0])
    for k, t in want.items():
        for i in (0, 1):
            sums[k[0], t][i] += paths[k][i + 1]
    verdicts = {(r["host"], r["typed"]): r["rejected"] for r in urls.template_verdicts(labelled).collect()}
    assert verdicts == {k: (sums[k[0], t][1] + urls.PRIOR * urls.STRENGTH) / (sums[k[0], t][0] + urls.STRENGTH) >= urls.REJECT for k, t in want.items()}


def test_variable_segments_do_not_part_what_lies_below(spark):
    name = lambda i: "".join(chr(97 + (i * 7 + k * 3 + i // 5) % 26) for k in range(4 + i % 3))
    bad = [f"http://h.com/{name(i)}/casino/{name(i + 9)}" for i in range(200)]
    good = [f"http://h.com/{name(i)}/books/{name(i + 9)}" for i in range(200)] + [f"http://h.com/{name(3)}/books/on-casino"]
    users = [f"http://forum.com/user/{name(i)}/post/{name(2 * i)}" for i in range(300)]
    rows = bad + good + users
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(df).collect()}
    assert {got[i] for i in range(len(bad))} == {"block"}
    assert {got[i] for i in range(len(bad), len(rows))} == {"allow"}
    paths = urls.templates(df.select(urls.split_url(df.url)[0].alias("host"), urls.typed_path(urls.split_url(df.url)[1]).alias("typed")).distinct().selectExpr("host", "typed", "1L as n", "1L as lab", "0L as bad"))
    assert {r["template"] for r in paths.filter("host = 'forum.com'").collect()} == {"user/*/post/*"}


def test_columns_of_own_names_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "http://a.org/x", "h", "p", 3), (1, "http://a.org/x", "h", "p", 3), (None, None, "", "", 0), (2, "no scheme", "", "", 0)], "page_id long, url string, host string, prefix string, bad int")
    got = sorted((str(r["page_id"]), r["host"], r["path"], r["verdict"]) for r in urls.judge(df).collect())
    assert got == sorted([("1", "a.org", "/x", "allow")] * 2 + [("None", "", "", "allow"), ("2", "", "", "allow")])
