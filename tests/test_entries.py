"""Entries and counters of stored records against a plain reading of the dictionaries."""

import json
import random
from collections import Counter

import pytest

from ashlar.operators import entries

WHOLE = {"critical": "1", "high": "2", "medium": "3", "low": "4"}


def number(x):
    try:
        return int(float(x or 0))
    except (TypeError, ValueError):
        return 0


def plain_entries(r):
    names = r["repo_slugs"] if "repo_slugs" in r else r.get("repos")
    names = [n.strip() for n in (names if isinstance(names, list) else []) if n and n.strip()]
    path = (r.get("local_repo_path") or "").strip()
    names = names or ([path.rstrip("/").split("/")[-1] or path] if path else ["Unknown"])
    found, new = Counter(), Counter()
    for f in r.get("findings") or []:
        repo = (f.get("repo") or "").strip()
        if repo:
            found[repo] += 1
            new[repo] += (f.get("delta_status") or "").strip().lower() == "new"
    for n in names:
        part = (r.get("per_repo") or {}).get(n) or {}
        sev = {k: number((part.get("sev") or {}).get(level)) for k, level in WHOLE.items()}
        total = number(part["count"]) if "count" in part else found[n]
        fixed = 0
        count = new[n]
        if len(names) == 1:
            given = r["total"] if "total" in r else r.get("active_total", total)
            total = number(given) or total
            sev = {k: number((r.get("sev") or {}).get(k)) or v for k, v in sev.items()}
            count = number((r.get("delta") or {}).get("new_count")) or count
            fixed = number((r.get("delta") or {}).get("fixed_count"))
        prod = [(number(r.get(f"{k}_prod")) if len(names) == 1 else 0) or sev[k] for k in ("critical", "high")]
        yield (n, total, *sev.values(), *prod, count, fixed)


def record(rng):
    pick = lambda *x: rng.choice(x)
    r = {}
    if rng.random() < 0.6:
        r["repo_slugs"] = pick(None, [], ["a"], ["a", " b "], [" ", "b"], "text")
    if rng.random() < 0.6:
        r["repos"] = pick(None, ["c"], ["a", "c"])
    if rng.random() < 0.5:
        r["local_repo_path"] = pick("", None, "/srv/x/", "/", "deep/y")
    if rng.random() < 0.6:
        r["findings"] = pick(None, [], [{"repo": pick("a", " b", "", None), "delta_status": pick("New ", "old", None), "provider_or_lib": pick("r1", "", None), "category": pick("c1", None), "_hash": pick("h1", "h2", ""), "triage_status": pick(None, "false_positive", "")} for _ in range(4)])
    if rng.random() < 0.6:
        r["per_repo"] = pick(None, {"a": pick(None, {"count": pick(0, 7, None, "5"), "sev": {"1": pick(1, "2", None), "3": 4}}, {"sev": None})})
    for k in ("total", "active_total", "critical_prod"):
        if rng.random() < 0.4:
            r[k] = pick(0, None, 9, "8", "x")
    if rng.random() < 0.5:
        r["sev"] = pick(None, {"critical": pick(0, 3), "low": 2})
    if rng.random() < 0.5:
        r["delta"] = pick(None, {"new_count": pick(0, 5), "fixed_count": pick(None, 6)})
    if rng.random() < 0.6:
        r["trend"] = pick(None, {"rules": pick(None, {"active": {"r1": pick(2, None), "r9": 1}, "suppressed": pick(None, {"r1": 3})})})
    return r


@pytest.mark.parametrize("seed", [1, 2])
def test_records_of_all_shapes(spark, seed):
    rng = random.Random(seed)
    records = [record(rng) for _ in range(150)]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(900, "no json"), (901, "[1]"), (902, None), (903, "7")]
    df = entries.read(spark.createDataFrame(rows, "id int, record string"))
    got = Counter(tuple(r) for r in entries.repo_entries(df, ["id"]).collect())
    assert got == Counter((i, *e) for i, r in enumerate(records) for e in plain_entries(r))
    live = {"h1": "False_Positive ", "h2": "reviewed"}
    want = {}
    for r in records:
        if r.get("findings"):
            for f in r["findings"]:
                rule = f.get("provider_or_lib") or f.get("category") or "unknown"
                status = (live.get(f["_hash"]) or f["triage_status"] or "").strip().lower()
                want.setdefault(rule, [0, 0])[status == "false_positive"] += 1
        else:
            kept = (r.get("trend") or {}).get("rules") or {}
            for side, kind in enumerate(("active", "suppressed")):
                for rule, n in (kept.get(kind) or {}).items():
                    want.setdefault(rule, [0, 0])[side] += number(n)
    triage = spark.createDataFrame(list(live.items()), "hash string, status string")
    got = {r["rule"]: [r["active"], r["suppressed"]] for r in entries.rule_counters(df, triage, ["id"]).collect()}
    assert got == want
    assert all(r["noisy"] == r["active"] + r["suppressed"] for r in entries.rule_counters(df, triage, ["id"]).collect())
