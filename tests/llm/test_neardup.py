"""Near-dedup against all pairs by brute force, and the alignment against dynamic programming."""

import random
from collections import defaultdict

import numpy as np

from ashlar.llm import neardup
from ashlar.llm.components import components


def shingle_set(text):
    w = (text or "").lower().split()
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()


def brute(rows):
    """Least id of the class of every row, from all pairs of Jaccard 0.8 or more."""
    sets = {i: shingle_set(t) for i, t in rows}
    text = {i: t or "" for i, t in rows}
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    for i, s in sets.items():
        shared = defaultdict(int)
        for x in s:
            for j in where[x]:
                shared[j] += 1
        for j, n in shared.items():
            if n >= 0.8 * (len(s) + len(sets[j]) - n):
                parent[max(find(i), find(j))] = min(find(i), find(j))
        for j in sets:
            if text[j] == text[i]:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in sets}


def corpus():
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(40):
        base = [rng.choice(vocab) for _ in range(rng.choice([4, 12, 60, 150, 400]))]
        rows.append(" ".join(base))
        for _ in range(rng.randrange(0, 5)):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 60)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append(" ".join(copy))
    hot = [rng.choice(vocab) for _ in range(200)]
    for _ in range(60):  # more near copies than SMALL
        copy = list(hot)
        copy[rng.randrange(200)] = rng.choice(vocab)
        rows.append(" ".join(copy))
    passage = [rng.choice(vocab) for _ in range(60)]
    rows += [" ".join(passage + [rng.choice(vocab) for _ in range(60)]) for _ in range(60)]
    rows += ["", None, "", "one", "one", "a b c", "x " * 5000, "x " * 5000 + "y"]
    return list(enumerate(rows))


def test_classes_match_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, node int, class_id int")
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs).collect()}
    want = brute(rows)
    wrong = [i for i in want if got[i] != want[i]]
    assert not wrong, [(i, got[i], want[i], (rows[i][1] or "")[:60]) for i in wrong[:5]]
    kept = neardup.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


def test_alignment_is_the_shortest_edit():
    def lcs(a, b):
        p = [0] * (len(b) + 1)
        for x in a:
            q = [0]
            for j, y in enumerate(b):
                q.append(p[j] + 1 if x == y else max(p[j + 1], q[-1]))
            p = q
        return p[-1]

    rng = random.Random(1)
    for _ in range(300):
        a = [rng.randrange(6) for _ in range(rng.randrange(14))]
        b = [x for x in a if rng.random() > 0.15] + [rng.randrange(6) for _ in range(rng.randrange(3))]
        d = len(a) + len(b) - 2 * lcs(a, b)
        assert neardup.aligned(np.array(a, np.uint64), np.array(b, np.uint64), 40) == d
        assert not d or neardup.aligned(np.array(a, np.uint64), np.array(b, np.uint64), d - 1) is None


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 40)] + [(5, 5)]
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in range(7, 40)}}


def test_empty_table_and_null_ids(spark):
    assert neardup.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (3, "other words are here now")], "doc_id long, text string")
    assert neardup.classes(docs).count() == 3
    assert neardup.drop_near_copies(docs).count() == 2


def test_pairs_away_from_the_hub_in_a_crowded_bucket(spark):
    """Texts that share a passage but are not alike, and pairs among them that share a little more."""
    rng = random.Random(3)
    new = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    passage = new(160)
    rows = [passage + new(30) for _ in range(540)]
    for _ in range(30):
        more = new(11)
        rows += [passage + more + new(19), passage + more + new(19)]
    rows = list(enumerate(" ".join(r) for r in rows))
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - (i - 540) % 2 if i >= 540 else i for i, _ in rows}


def test_one_row_of_every_class_where_ids_are_null_or_repeat(spark):
    words = lambda x: " ".join(f"{x}{i}" for i in range(30))
    rows = [(None, words("a")), (None, words("b")), (None, words("c")), (None, words("c")), (5, words("d")), (5, words("e")), (9, words("e")), (None, words("e") + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in neardup.drop_near_copies(docs).collect())
    assert kept == [(0, words("a")), (0, words("b")), (0, words("c")), (5, words("d")), (5, words("e"))]
