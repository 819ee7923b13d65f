"""Lives of findings against a plain sequential reading of the history."""

import random
from datetime import datetime

from ashlar.operators import lifecycle as op

SCHEMA = "seq long, scan_id string, repo string, started string, hash string, severity int, severity_label string, file string, capability string, triage_status string, project_key string, rule string, context string, line string, description string, snippet string, policy_status string"


def stamp(raw):
    try:
        return int(datetime.fromisoformat(raw.replace("Z", "+00:00")).timestamp()), raw
    except ValueError:
        return 0, raw


def sequential(rows, fixed, triage):
    """A dictionary per hash that each row in time order updates where it has a value."""
    lives = {}
    for r in sorted(rows, key=lambda r: (*stamp(r["started"]), r["seq"])):
        if not r["hash"]:
            continue
        life = lives.setdefault(r["hash"], {"first": r["scan_id"], "n": 0, "hits": 0, "severity": 4, "file": None, "capability": None})
        life["n"] += 1
        life["hits"] += r["triage_status"] == "false_positive"
        life["last"], life["last_ts"] = r["scan_id"], stamp(r["started"])[0]
        for k in ("severity", "file", "capability"):
            life[k] = r[k] or life[k]
    for r in sorted(rows, key=lambda r: r["seq"]):
        if r["hash"]:
            lives[r["hash"]].setdefault("repo", r["repo"])
    for h, life in lives.items():
        t = {"reviewed": "in_remediation"}.get(triage.get(h), triage.get(h))
        at = fixed.get(h, (0, ""))[0]
        life["status"] = t if t in ("accepted_risk", "false_positive") else "fixed" if at and at >= life["last_ts"] else t or "open"
    return lives


def test_lifecycle_equals_sequential_reading(spark):
    rng = random.Random(1)
    scans, rows, seq = [], [], 0
    for s in range(40):
        started = f"2024-01-{s // 2 % 28 + 1:02d}T{s % 24:02d}:00:00Z" if s % 9 else f"soon {s}"
        scans.append((f"s{s}", f"r{s % 3}", started, f"2024-03-{s % 28 + 1:02d}T00:00:00Z" if s % 4 == 0 else ""))
        for _ in range(rng.randint(0, 8)):
            seq += 1
            rows.append((seq, f"s{s}", f"r{s % 3}", started, rng.choice(["a", "b", "c", "d", "", None]), rng.choice([0, 1, 2, None]), None, rng.choice(["", None, "x.py", "y.py"]),
                         rng.choice(["", "c1", "c2"]), rng.choice([None, "false_positive"]), "p", "rule", "production", "1", "", None, ""))
    triage = {"a": "reviewed", "b": "false_positive"}
    findings = spark.createDataFrame(rows, SCHEMA)
    marks = op.fixes(spark.createDataFrame(scans, "scan_id string, repo string, started string, completed string"), findings)
    t = spark.createDataFrame([(h, s, "n", "by", "at") for h, s in triage.items()], "hash string, status string, note string, marked_by string, marked_at string")
    got = {r["hash"]: r for r in op.lifecycle(findings, marks, t, ["seq"]).collect()}
    held = {s[0]: {r[4] for r in rows if r[1] == s[0] and r[4]} for s in scans}
    fixed = {}
    for repo in ("r0", "r1", "r2"):
        mine = sorted((s for s in scans if s[1] == repo), key=lambda s: (*stamp(s[2]), s[0]))
        for before, after in zip(mine, mine[1:], strict=False):
            for h in held[before[0]] - held[after[0]]:
                fixed[h] = max(fixed.get(h, (0, "")), stamp(after[3] or after[2]))
    names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
    want = sequential([dict(zip(names, r, strict=True)) for r in rows], fixed, triage)
    assert set(got) == set(want)
    for h, life in want.items():
        r = got[h]
        assert (r["first_seen_scan_id"], r["last_seen_scan_id"], r["scan_count"], r["suppression_hits"]) == (life["first"], life["last"], life["n"], life["hits"])
        assert (r["severity"], r["file"], r["capability"], r["repo"], r["status"]) == (life["severity"], life["file"], life["capability"], life["repo"], life["status"])
        assert bool(r["triage_by"]) == (h in triage and r["status"] != "fixed")


def test_lifecycle_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    marks = op.fixes(spark.createDataFrame([], "scan_id string, repo string, started string, completed string"), empty)
    t = spark.createDataFrame([], "hash string, status string, note string, marked_by string, marked_at string")
    lives = op.lifecycle(empty, marks, t, ["seq"])
    assert lives.count() == 0 and op.status_counts(lives).first()["total"] == 0


def test_fixes_hold_no_table_of_sightings(spark):
    """Sightings meet by sorted keys alone: tables of them in memory were the largest tasks."""
    findings = spark.createDataFrame([("a", "h"), ("a", "h"), ("a", "k"), ("b", "k"), ("b", "k"), ("c", None), ("c", "")], "scan_id string, hash string")
    scans = spark.createDataFrame([(s, "r", f"2024-01-0{n}T00:00:00Z", "") for n, s in enumerate("abc", 1)], "scan_id string, repo string, started string, completed string")
    marks = op.fixes(scans, findings)
    assert {(r["hash"], r["fixed"]["raw"]) for r in marks.collect()} == {("h", "2024-01-02T00:00:00Z"), ("k", "2024-01-03T00:00:00Z")}
    assert "HashAggregate" not in marks._jdf.queryExecution().executedPlan().toString()


def test_summary_holds_no_table_of_sightings(spark):
    """The fixes within the summary: no aggregate by scan and hash."""
    from ashlar.plans import lifecycle as plan

    got = plan.QUERIES["finding_status_summary"](spark, "/root/testdata/sf0.001")
    assert "keys=[scan_id" not in got._jdf.queryExecution().executedPlan().toString()
