"""Snapshots, changes, scopes and the git source, against plain Python and real repositories."""

import hashlib
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from ashlar.plans import snapshots as plan
from ashlar.sources import git, snapshots


def tree(rng, repos, paths):
    return {(r, p): f"text {rng.randrange(4)}" for r in repos for p in paths if rng.random() < 0.6}


def frame(spark, files):
    rows = [(r, p, len(t), t) for (r, p), t in files.items()]
    return snapshots.manifest(spark.createDataFrame(rows, "repo string, path string, size long, content string"))


def plain_changes(old, new):
    out = {k: ("modified", None) for k in old.keys() & new.keys() if old[k] != new[k]}
    added, gone = sorted(new.keys() - old.keys()), sorted(old.keys() - new.keys())
    free = list(gone)
    for k in added:
        match = next((g for g in free if g[0] == k[0] and old[g] == new[k]), None)
        if match:
            free.remove(match)
        out[k] = ("renamed", match[1]) if match else ("added", None)
    return out | {k: ("deleted", None) for k in free}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_changes_and_scope(spark, seed):
    rng = random.Random(seed)
    repos, paths = ["a", "b", "c"], [f"d/f{i}.py" for i in range(8)]
    old, new = tree(rng, ["a", "b"], paths), tree(rng, repos, paths)
    new |= {k: v for k, v in old.items() if k[0] == "b"}
    got = {(r["repo"], r["path"]): (r["change"], r["was"]) for r in snapshots.changes(frame(spark, old), frame(spark, new)).collect()}
    want = plain_changes(old, new)
    assert got == want
    scan = {tuple(r) for r in snapshots.to_scan(frame(spark, new), frame(spark, old)).collect()}
    assert scan == {k for k, (c, _) in want.items() if c != "deleted" and k[0] in ("a", "b")} | {k for k in new if k[0] == "c"}


def test_store_falls_back_to_all_files(spark, tmp_path):
    rng = random.Random(5)
    old, new = tree(rng, ["a"], ["x", "y", "z"]), {("a", "x"): "1", ("a", "q"): "2"}
    store = snapshots.Snapshots(spark, str(tmp_path / "s"))
    store.save("base", frame(spark, old))
    store.save("same", frame(spark, new))
    scan = lambda kind, **kw: {r["path"] for r in store.scope(kind, frame(spark, new), **kw).collect()}
    assert scan("full") == scan("changed_files", previous="lost") == scan("branch_diff") == scan("odd kind") == {"x", "q"}
    assert scan("Baseline_Rescan ", baseline="same") == set()  # compared and nothing changed, unlike not compared
    assert scan("branch_diff", branch="base") == {k[1] for k, v in new.items() if old.get(k) != v}


def test_names_of_all_files_contents_of_some(spark, tmp_path):
    root = tmp_path / "trees"
    files = {"r/src/a.py": "x", "r/big.json": "y" * 50, "r/logo.png": "z", "r/node_modules/m.js": "n", "r/Dockerfile": "d", "r/.github/workflows/ci.sh": "w", "s/README": "é", "s/build": "b"}
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    got = {(r["repo"], r["path"]): r["content"] for r in snapshots.read_facts_files(spark, str(root), 40).collect()}
    assert got == {("r", "src/a.py"): "x", ("r", "big.json"): None, ("r", "logo.png"): None, ("r", "Dockerfile"): "d", ("r", ".github/workflows/ci.sh"): "w", ("s", "README"): "é"}
    assert ("r", "big.json") in {(r["repo"], r["path"]) for r in snapshots.read_facts_files(spark, str(root), None).filter("content is not null").collect()}


def run(path, *args):
    subprocess.run(["git", "-C", str(path), "-c", "user.name=n", "-c", "user.email=e@x", *args], check=True, capture_output=True)


def test_git_source_reads_deleted_files(spark, tmp_path):
    for name in ("one", "two"):
        clone = tmp_path / "clones" / name
        (clone / "src").mkdir(parents=True)
        run(clone, "init", "-q")
        for step, (path, text) in enumerate([("src/ä b.py", f"first {name}"), ("notes.md", "n" * 30), ("pic.png", "p"), ("src/ä b.py", f"second {name}"), ("empty.py", "")]):
            (clone / path).write_text(text)
            run(clone, "add", "-A")
            run(clone, "commit", "-qm", f"add {step}")
            (clone / path).unlink()
            run(clone, "add", "-A")
            run(clone, "commit", "-qm", f"remove {step}")
    git.register(spark)
    read = lambda **kw: spark.read.format("git_deleted").options(root=str(tmp_path / "clones"), **kw).load()
    rows = read(most="all", max_chars="all")
    assert rows.rdd.getNumPartitions() == 2
    got = {(r["repo"], r["path"]): r["content"] for r in rows.collect()}
    assert got == {(n, "src/ä b.py"): f"second {n}" for n in ("one", "two")} | {(n, "notes.md"): "n" * 30 for n in ("one", "two")}
    assert {r["path"] for r in read(max_chars="20").collect()} == {"src/ä b.py"}
    assert {r["path"] for r in read(most="2").collect()} == {"src/ä b.py"}  # the empty file's entry counts among the two
    one = spark.read.format("git_deleted").option("repos", f"x={tmp_path / 'clones' / 'one'}").load()
    assert {r["repo"] for r in one.collect()} == {"x"} and all(len(r["commit"]) == 40 for r in one.collect())


def test_manifest_digest(spark):
    row = frame(spark, {("r", "p"): "é"}).first()
    assert row["digest"] == hashlib.sha256("é".encode()).hexdigest()


def test_scope_makes_manifests_of_two_scans_a_repository(spark, monkeypatch):
    made, real = [], plan.manifests
    monkeypatch.setattr(plan, "manifests", lambda of: made.append(real(of)) or made[-1])
    plan.QUERIES["scope_of_changes"](spark, "/root/testdata/sf0.001")
    per = [r["n"] for r in made[0].groupBy("repo").agg(F.countDistinct("snapshot").alias("n")).collect()]
    assert per and max(per) == 2
