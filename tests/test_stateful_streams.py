"""The streamed log clock and the keyed table: any split into batches, with restarts, gives the batch result."""

import random

import pytest
from pyspark.sql import functions as F

from ashlar.operators import logs
from ashlar.sources.shared import Folder
from ashlar.streaming import clock, sessions


def log(rng, session, n):
    second, rows = rng.randrange(86400), []
    for seq in range(1, n + 1):
        second = (second + rng.choice([0, 1, 50, 40000])) % 86400
        stamp = f"[{second // 3600:02d}:{second // 60 % 60:02d}:{second % 60:02d}] " if rng.random() < 0.8 else ""
        rows.append((session, seq, f"{stamp}{'Scan complete.' if seq == n else f'line {seq}'}"))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_streamed_clock_equals_batch_clock(spark, tmp_path, seed):
    rng = random.Random(seed)
    lines = [r for s in ("a", "b", "c") for r in log(rng, s, rng.randint(5, 25))]
    back, live, out, check = (str(tmp_path / x) for x in ("back", "live", "out", "check"))
    put = lambda rows, where: spark.createDataFrame(rows, clock.LINE).coalesce(1).write.mode("append").parquet(where)
    put([r for r in lines if r[1] <= 4], back)
    mixed = rng.sample(lines, len(lines)) + rng.choices(lines, k=10)  # the backlog's lines and repeated ones among them
    for part in range(2):
        half = mixed[part::2]
        for i in range(3):
            put(half[i::3], live)
        stream = clock.clocked(clock.backlog_then_live(spark, back, live, 1))
        clock.send(stream, out, check).awaitTermination()  # the second run restarts from the checkpoint
    got = sorted((r["session"], r["seq"], r["msg"], r["ts"], r["last"]) for r in spark.read.parquet(out).collect())
    batch = logs.clock(logs.parse(spark.createDataFrame(lines, clock.LINE), "text"), "session", "seq", "second_of_day")
    want = sorted((r["session"], r["seq"], r["msg"], r["ts"], r["msg"] == "Scan complete.") for r in batch.collect())
    assert got == want and sum(r[4] for r in got) == 3


def test_clock_flushes_over_gaps_when_patience_ends():
    c = clock.Clock(1)
    for seq in (1, 3, 4):
        c.put(seq, 100 - seq, f"m{seq}", False)
    assert [x[0] for x in c.take()] == [1]
    c = clock.Clock(1, c.saved())
    assert [x[:1] + x[2:3] for x in c.take(flush=True)] == [(3, 97 + 86400), (4, 96 + 2 * 86400)]
    c.put(2, 5, "late", False)
    assert not list(c.take()) and c.position == 4


SCHEMA = "id long, at long, state string, hits long, top long"


def table(spark, tmp_path, **kw):
    return sessions.KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["id"], "at", {"hits": "sum", "top": "max"}, buckets=4, **kw)


def expected(updates):
    """Latest state, sums and maxima since the last deletion of each key."""
    rows = {}
    for n, (i, at, state, hits, top, gone) in enumerate(updates):
        rows.setdefault(i, []).append((at, n, state, hits, top, gone))
    out = {}
    for i, ups in rows.items():
        ups.sort()
        dead = max((k for k, u in enumerate(ups) if u[5]), default=-1)
        if dead < len(ups) - 1:
            since = ups[dead + 1 :]
            out[i] = (ups[-1][0], ups[-1][2], sum(u[3] for u in since), max(u[4] for u in since))
    return out


def test_keyed_table_equals_all_updates(spark, tmp_path):
    rng = random.Random(4)
    t = table(spark, tmp_path)
    done = []
    for number in range(5):
        batch = [(rng.randrange(12), number * 10 + k, f"s{number}.{k}", rng.randrange(5), rng.randrange(100), rng.random() < 0.2) for k in range(6)]
        done += batch
        df = spark.createDataFrame(batch, SCHEMA + ", deleted boolean")
        assert t.upsert(df, number, "w") and not t.upsert(df, number, "w")  # a batch that comes again is known
        got = {r["id"]: (r["at"], r["state"], r["hits"], r["top"]) for r in t.read().collect()}
        assert got == expected(done)
    before = {r["id"] for r in t.read(t.version() - 1).collect()}
    assert before == set(expected(done[:-6]))
    assert len([n for n in Folder(spark, t.path).names("manifests") if n.isdigit()]) == 2


def test_a_late_older_update_brings_nothing_back(spark, tmp_path):
    t = table(spark, tmp_path)
    t.upsert(spark.createDataFrame([(1, 5, "x", 1, 1, True)], SCHEMA + ", deleted boolean"), 0)
    t.upsert(spark.createDataFrame([(1, 4, "y", 1, 1)], SCHEMA), 1)
    assert t.read().count() == 0
    t.upsert(spark.createDataFrame([(1, 6, "z", 2, 1)], SCHEMA), 2)
    assert [r["hits"] for r in t.read().collect()] == [2]


def test_commit_rewrites_touched_buckets_only(spark, tmp_path):
    t = table(spark, tmp_path)
    t.upsert(spark.createDataFrame([(i, 0, "x", 1, 1) for i in range(40)], SCHEMA), 0)
    old = t.manifest()["buckets"]
    t.upsert(spark.createDataFrame([(7, 1, "y", 1, 1)], SCHEMA), 1)
    new = t.manifest()["buckets"]
    assert len(old) == 4 and sum(new[b] != old[b] for b in old) == 1
    assert t.remove(spark.createDataFrame([(7,), (8,)], "id long"), 2) and t.read().count() == 38


def test_replace_rows_of_a_scan(spark, tmp_path):
    t = sessions.KeyedTable(spark, str(tmp_path / "l"), "scan string, seq long, line string", ["scan"], "seq")
    rows = lambda *r: spark.createDataFrame(list(r), "scan string, seq long, line string")
    t.replace(rows(("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")), "scan", 0)
    t.replace(rows(("a", 1, "new")), "scan", 1)
    assert sorted(map(tuple, t.read().collect())) == [("a", 1, "new"), ("b", 1, "z")]


def test_a_failed_commit_changes_nothing(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    t.upsert(spark.createDataFrame([(1, 0, "x", 1, 1)], SCHEMA), 0)
    monkeypatch.setattr(t.folder, "create", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        t.upsert(spark.createDataFrame([(1, 1, "y", 1, 1)], SCHEMA), 1)
    assert [r["state"] for r in t.read().collect()] == ["x"]
    monkeypatch.undo()
    assert t.upsert(spark.createDataFrame([(1, 1, "y", 1, 1)], SCHEMA), 1) and [r["hits"] for r in t.read().collect()] == [2]


def test_stream_of_updates_restarts(spark, tmp_path):
    t = table(spark, tmp_path)
    src = str(tmp_path / "in")
    for part in range(3):
        spark.createDataFrame([(part % 2, part, f"s{part}", 1, part)], SCHEMA).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src).filter(F.col("id").isNotNull())
        t.follow(stream, str(tmp_path / "c"), "stream").awaitTermination()
    assert {tuple(r) for r in t.read().collect()} == {(0, 2, "s2", 2, 2), (1, 1, "s1", 1, 1)}
