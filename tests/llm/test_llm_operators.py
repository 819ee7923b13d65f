"""The other training-data operators on edge cases and against plain Python."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ashlar.llm import decontam, embeddings, html, licenses, lm, mixing, quality, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, target int"


def docs(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, None, source, len(t or ""), 1, 2) for i, t in enumerate(texts)], DOCS)


EDGE = ["", None, "one", " \n\t ", "é ñ 漢字 😀", "word " * 30_000, "same text here", "same text here"]


def test_quality_learns_and_survives_edges(spark):
    good = [f"The house number {i} stands near the river, and people of town {i % 7} like it." for i in range(60)]
    bad = [f"BUY{i}!!! " * 20 for i in range(60)]
    d = docs(spark, good + bad + EDGE)
    labels = spark.createDataFrame([(i, int(i < 60), "x") for i in range(120)] + [(3, 0, "both labels"), (None, 1, "")], "doc_id long, quality int, text string")
    rows = {r["doc_id"]: r for r in quality.score(d, labels).collect()}
    assert len(rows) == 128 and all(0 <= r["score"] <= 1 for r in rows.values())
    held = [i for i in range(120) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(rows[i]["held_out"] == (i in held) for i in range(120))
    assert sum(rows[i]["predicted"] == (i < 60) for i in held) >= 0.95 * len(held)
    assert rows[6 + 120]["score"] == rows[7 + 120]["score"]
    kept = quality.keep_good(d, labels)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in rows.items() if r["predicted"]}
    assert {r["score"] for r in quality.score(docs(spark, EDGE), labels.limit(0)).collect()} == {0.5}


def test_lm_base_matches_brute_force_and_model_is_normalised(spark):
    texts = ["The cat sat on the mat", "the CAT ran", "a dog ran on the road"] * 40 + EDGE
    rows = {r["doc_id"]: r for r in lm.score(docs(spark, texts)).collect()}
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) + [None]
    count = Counter()
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            count.update(words(t))
    n, v = sum(count.values()), len(count)
    for i, t in enumerate(texts):
        assert rows[i]["train_tokens"] == n and rows[i]["n_tokens"] == len(words(t))
        assert rows[i]["n_known"] == sum(count[w] > 0 for w in words(t))
        assert rows[i]["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words(t)), rel=1e-9)
    held = [r for i, r in rows.items() if r["held_out"] and i < 120]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    model = lm.Model(np.array([40.0, 90, 7, 3] + [0] * lm.REST))
    normal = model.normalisers(np.arange(model.classes + 1))
    every = np.arange(model.classes)
    for topic in range(lm.GROUPS + 1):
        for previous in (0, 2, model.classes):
            p = model.log_p(np.full(len(every), topic), np.full(len(every), previous), every, normal)
            assert (10.0**p).sum() == pytest.approx(1.0, abs=1e-5)


def test_decontamination_matches_brute_force(spark):
    item = " ".join(f"w{i}" for i in range(30))
    broken = " ".join(f"w{i}" if i != 15 else "zz" for i in range(30))  # 21 of 26 shingles: 0.81
    worse = " ".join(f"w{i}" if i not in (10, 20) else "zz" for i in range(30))
    texts = [f"x y {item} z", f"q {broken} r", worse, "x " * 50_000 + item.upper().replace(" ", ",\n "), "unrelated words only in this one"] + EDGE
    items = spark.createDataFrame([(1, item, 5), (2, item, 5), (3, "too short", 5), (4, None, 5), (5, "five words are an item", 5)], "item_id long, text string, doc_id int")
    d = docs(spark, texts)
    got = sorted((r["doc_id"], r["item_id"]) for r in decontam.search(d, items).collect())
    assert got == [(0, 1), (1, 1), (3, 1)]
    left = decontam.drop_contaminated(d, items)
    assert left.columns == d.columns and sorted(r["doc_id"] for r in left.collect()) == [2, *range(4, len(texts))]
    assert decontam.search(d.limit(0), items).count() == 0 and decontam.search(d, items.limit(0)).count() == 0


def test_mix_meets_targets_and_never_exceeds_twice(spark):
    rows = [(i, "w " * (1 + i % 9), src) for i, src in enumerate((["a"] * 300 + ["b"] * 100 + ["c"] * 100 + [None] * 50))]
    rows += [(9000, None, "a"), (9001, "", "empty source"), (9002, "dup", "b"), (9002, "dup", "b")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumnRenamed("doc_id", "doc_id")
    got = mixing.mix(d).collect()
    assert len(got) == len(rows) and all(r["taken"] <= 2 * r["size"] and r["taken"] % max(r["size"], 1) == 0 for r in got)
    total, by = sum(r["size"] for r in got), {}
    for r in got:
        by.setdefault(r["source"], []).append(r)
    assert sum(v[0]["target"] for v in by.values()) == pytest.approx(1.5 * total)
    for v in by.values():
        assert v[0]["target"] <= 2 * v[0]["source_size"] and abs(sum(r["taken"] for r in v) - v[0]["target"]) <= 5
        low = v[0]["target"] // v[0]["source_size"] if v[0]["source_size"] else 0
        assert all(r["taken"] >= low * r["size"] for r in v)
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix(d.repartition(3)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in got}
    assert mixing.mix(d.limit(0)).count() == 0


def test_embeddings_edges(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.1]), (4, [0.0, 1.0]), (5, None), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (11, []), (12, [1e300, 0.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got[1] == (4, 1, True) and got[3] == (4, 1, False) and got[None] == (4, 1, False) and got[12][0] == 4
    assert all(got[i] == (0, i, True) for i in (4, 5, 6, 7, 8, 9, 11))
    assert embeddings.links(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_html_edges(spark):
    article = "<html><body><nav><a>Menu</a></nav><header>Site</header><div class='sidebar'>Left, side.</div><div class=main-text><h1>Head &amp; l&iacute;ne</h1><p>First, with <b>bold</b> text.\n  More.<p>Second; one.</div><div id='comments'><p>Nice post, really. I like it, and more.</p></div><form>Name</form><footer>Foot</footer></body></html>"
    rows = [(1, "u", article), (2, None, None), (3, "u", ""), (4, "u", "<p>only <script>var a='<p>x</p>'</script>text"), (4, "u", "<p>only"), (5, "u", "<" * 1000), (6, "u", "<div>" * 3000 + "deep")]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, text string")
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in html.extract_pages(pages).collect()]
    assert got[0] == (1, "Head & líne\nFirst, with bold text. More.\nSecond; one.", 53)
    assert [g[1] for g in got[1:3]] == ["", ""] and got[3][1] == "only text" and got[6][1] == "deep" and len(got) == len(rows)


def test_licenses(spark):
    mit = 'Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal.\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED.'
    apache = "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at x"
    texts = [mit, apache, "prose.\nReleased under the MIT License.\nmore", "SPDX-License-Identifier: GPL-3.0", "This work is licensed under CC BY-NC 4.0. And GPLv3? Released under GPLv2.", "no licence at all"] + EDGE
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(docs(spark, texts)).collect()}
    assert [got[i] for i in range(6)] == ["MIT", "Apache-2.0", "MIT", "GPL-3.0", "CC-BY-NC-4.0,GPL-2.0", ""]
    assert all(got[i] == "" for i in range(6, len(texts)))


def test_urls(spark):
    rows = ["http://A.Example.NET/en/1", "http://example.net/de/1", "https://x.example.com/de/2?q", "ftp://sub.org/fr/", "http://net", "no scheme", None, "http://casino-x.example.com/en/5", "http://fine.example.com/en/5#a", "://", "http://h/" + "a/" * 5000]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(rows)] * 2, "page_id long, url string, host string, typed string")
    got = {r["page_id"]: (r["host"], r["rule"], r["verdict"]) for r in urls.judge(pages).collect()}
    assert got[0] == ("a.example.net", "example.net/en/", "allow") and got[1] == ("example.net", "net/", "block")
    assert got[2] == ("x.example.com", "example.com/de/", "block") and got[3] == ("sub.org", "org/fr/", "allow")
    assert got[4] == ("net", None, "allow") and got[5] == ("", None, "allow") and got[6] == ("", None, "allow")
    assert got[8][2] == "allow" and got[10][2] == "allow" and urls.judge(pages).count() == 2 * len(rows)
    assert urls.judge(pages.limit(0)).count() == 0
