"""Operators against plain Python versions, and cases in which the method itself decides."""

import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest

from ashlar.llm import decontam, html, licenses, lm, mixing, quality, secrets, urls

PROSE = "The river rose, and the town waited; nobody knew how long it would last, or why. "


def page(*parts):
    return "<html><body>" + "".join(parts) + "</body></html>"


MENU = "<div><ul>" + "".join(f"<li><a href=/{i}>Link {i}</a></li>" for i in range(9)) + "</ul></div>"
PARAGRAPHS = "".join(f"<p>{PROSE * (2 + i % 2)}</p>" for i in range(4))
WANT = "\n".join((PROSE * (2 + i % 2)).strip() for i in range(4))


def test_html_paths_decide_where_nothing_is_named(monkeypatch):
    cases = [
        page(MENU, f"<div><h1>Title</h1>{PARAGRAPHS}</div>", MENU),
        page(MENU, f"<div><h1>Title</h1><div>{PARAGRAPHS}</div></div>", MENU),
        page(MENU, f"<main><h1>Title</h1><article>{PARAGRAPHS}</article></main>", MENU),
        page(MENU, f"<div class='has-sidebar'><h1>Title</h1>{PARAGRAPHS}</div>", "<div hidden>Gone, all of it.</div><div style='display: none'>Gone too, yes.</div>", MENU),
        page(MENU, f"<div class='widget'><h1>Title</h1>{PARAGRAPHS}</div>", MENU),
    ]
    for c in cases:
        assert html.extract(c) == "Title\n" + WANT, c[:400]
    lead = page(MENU, f"<main><h1>Title</h1><p>{PROSE}</p><article>{PARAGRAPHS}</article></main>", MENU)
    assert html.extract(lead) == f"Title\n{PROSE.strip()}\n{WANT}"
    listed = page(MENU, f"<div><h1>Title</h1><p>{PROSE}</p><ol>" + f"<li>{PROSE * 3}</li>" * 5 + "</ol></div>", MENU)
    assert html.extract(listed) == "\n".join(["Title", PROSE.strip()] + [(PROSE * 3).strip()] * 5)
    monkeypatch.setattr(html, "path_scores", lambda found: {n.path: 1.0 for n, _ in found})
    assert "Link 3" in html.extract(cases[0])  # without the ratios the menus would stay


GRANTS = {
    "Released under CC0 1.0.": "CC0-1.0", "Distributed under LGPLv2.1.": "LGPL-2.1", "Distributed under AGPLv3.": "AGPL-3.0", "Published under MPL 2.0.": "MPL-2.0",
    "Available under Creative Commons Attribution 4.0.": "CC-BY-4.0", "Licensed under the MIT License.": "MIT", "Provided under an ISC license.": "ISC", "Released under the Unlicense.": "Unlicense",
    "Licenced under the Apache License, Version 2.0.": "Apache-2.0", "Redistributed under the zlib license.": "Zlib", "Released under the terms of the Boost Software License 1.0.": "BSL-1.0",
    "SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause", "SPDX-License-Identifier: CC-BY-SA-3.0": "CC-BY-SA-3.0",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License.": "GPL-3.0",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.": "GPL-2.0",
    "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published, either version 2.1 of the License.": "LGPL-2.1",
    "Neither the name of the town nor that of the river is known.": "", "He was released under a cloud.": "", "The permission was hereby refused.": "",
}


def test_every_licence_name_is_recognised_within_prose(spark):
    rows = [f"Some prose before it, and more.\n\n{g}\n\nProse after it." for g in GRANTS] + [g for g in GRANTS]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, licenses string")
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(df).collect()}
    want = list(GRANTS.values()) * 2
    assert [got[i] for i in range(len(rows))] == want
    assert licenses.scan(df.limit(0)).count() == 0


def test_quality_scores_equal_the_plain_formula(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("alpha beta gamma delta, epsilon. Zeta 12 !".split()) for _ in range(rng.randrange(1, 80))) + "x!" * (i % 2 * 9) for i in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 150, 1 + 0)], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, labels).collect()}
    x = np.array([quality.features(t) for t in texts])
    train = np.array([zlib.crc32(str(i).encode()) % 3 != 1 for i in range(150)])
    y = np.arange(150) % 2
    pooled = np.diag(x[train].var(0) + 1e-6)
    log_p = []
    for c in range(2):
        part = x[train & (y == c)]
        cov = 0.9 * np.cov(part.T, bias=True) + 0.1 * pooled + 1e-9 * np.eye(x.shape[1])
        d = x - part.mean(0)
        log_p.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1] + np.log((len(part) + 1) / (train.sum() + 2)))
    want = 1 / (1 + np.exp(np.clip(log_p[0] - log_p[1], -700, 700)))
    assert np.allclose([got[i] for i in range(150)], want, atol=1e-6)
    assert quality.score(docs.limit(0), labels).count() == 0


B64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def test_p_values_of_random_tokens_are_uniform_and_lone_ones_are_found(spark):
    rng = random.Random(6)
    from pyspark.sql import functions as F

    tokens = ["".join(rng.choice(B64) for _ in range(rng.choice([40, 64, 90]))) for _ in range(3000)]
    p = [r[0] for r in spark.createDataFrame([(t,) for t in tokens], "t string").select(secrets.battery(F.col("t"))).collect()]
    assert 0.45 < sum(x > 0.5 for x in p) / len(p) < 0.57 and 0.05 < sum(x < 0.1 for x in p) / len(p) < 0.15
    best = max(zip(p, tokens, strict=True))[1]
    alone = spark.createDataFrame([(1, f"key {best} end"), (2, "prose only")], "doc_id long, text string")
    assert [r["n_random"] for r in secrets.digest(alone).orderBy("doc_id").collect()] == [1, 0]
    assert [r["text"] for r in secrets.redact(alone).orderBy("doc_id").collect()] == ["key [SECRET] end", "prose only"]


def test_containment_equals_brute_force(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(400)]
    some = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [some(n) for n in (1, 2, 3, 4, 5, 6, 9, 14, 30, 60, 120)] + [["a"] * 12]
    items += [items[3], items[8]]  # the same shingles again
    docs = [some(rng.randrange(0, 300)) for _ in range(60)]
    for _ in range(60):
        item = list(rng.choice(items))
        for _ in range(len(item) // rng.choice([8, 20, 40])):
            item[rng.randrange(len(item))] = "zz"
        docs.append(some(rng.randrange(200)) + item + some(rng.randrange(200)))
    runs = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    want = set()
    for i, item in enumerate(items):
        k = min(5, len(item))
        s = runs(item, k)
        same = [j for j, other in enumerate(items) if runs(other, min(5, len(other))) == s]
        for d, words in enumerate(docs):
            n = len(s & runs(words, k))
            if n >= 0.8 * len(s):
                want.add((d, min(same), ",".join(map(str, same)), n, len(s)))
    text = lambda w: " ".join(w)
    d = spark.createDataFrame([(i, text(w)) for i, w in enumerate(docs)] + [(None, None), (7000, "")], "doc_id long, text string")
    b = spark.createDataFrame([(i, text(w).upper() + "!") for i, w in enumerate(items)] + [(99, ""), (98, None), (None, text(items[9]))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["item_ids"], r["n_shared"], r["n_shingles"]) for r in decontam.search(d, b).collect()}
    assert got == want
    assert {r["doc_id"] for r in decontam.drop_contaminated(d, b).collect()} == ({None, 7000} | set(range(len(docs)))) - {w[0] for w in want}


def test_a_template_goes_or_stays_as_a_whole(spark):
    rows = [f"http://shop.example.org/promo/casino-{c}" for c in "abcdefghijklmnopqrstuvwxyz"] + ["http://shop.example.org/promo/winter", "http://shop.example.org/promo/autumn"]
    rows += [f"http://shop.example.org/news/{c}{d}" for c in "abcdefgh" for d in "abcdefgh"] + ["http://shop.example.org/news/casino-closed"]
    deep = "/".join("abcdefgh")
    rows += [f"http://deep.org/{deep}/casino/{i}" for i in range(30)] + [f"http://deep.org/{deep}/books/{i}" for i in range(30)]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {rows[r["page_id"]]: r["verdict"] for r in urls.judge(df).collect()}
    assert got["http://shop.example.org/promo/winter"] == "block" and got["http://shop.example.org/promo/casino-a"] == "block"
    assert got["http://shop.example.org/news/casino-closed"] == "allow" and got["http://shop.example.org/news/ab"] == "allow"
    assert got[f"http://deep.org/{deep}/casino/3"] == "block" and got[f"http://deep.org/{deep}/books/3"] == "allow"
    labels = spark.createDataFrame([(u, 1) for u in rows[28:92]] + [(rows[0], 1), (rows[0], 0)], "url string, bad int")
    got = {rows[r["page_id"]]: r["verdict"] for r in urls.judge(df, labels=labels).collect()}
    assert got["http://shop.example.org/news/casino-closed"] == "block" and got["http://shop.example.org/promo/casino-a"] == "allow"
    many = spark.createDataFrame([(1, "http://h.org/" + "f" * 200_000), (2, "http://h.org/" + "a/" * 100_000)], "page_id long, url string")
    assert urls.judge(many).count() == 2


def test_rows_without_ids_are_sampled_one_by_one(spark):
    rows = [(None, f"word{i} " * (1 + i % 5), "a") for i in range(400)] + [(1, f"text{i} and more", "b") for i in range(300)] + [(2, "same row", "c")] * 50
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by = {}
    for r in got:
        by.setdefault(r["source"], []).append(r)
    for rs in by.values():
        assert abs(sum(r["taken"] for r in rs) - rs[0]["target"]) <= max(r["size"] for r in rs)
        assert all(r["taken"] <= 2 * r["size"] for r in rs)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert lm.score(docs).count() == 0
    assert html.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert re.match(r"\(\?i\)", licenses.TRIGGER) and pytest.approx(1.0) == 1.0


def test_the_language_model_learns_what_follows(spark):
    """Words in a fixed cycle: after training each is likelier than its share."""
    cycle = [f"w{i}" for i in range(30)]
    made = [(i, " ".join(cycle[(i + k) % 30] for k in range(60))) for i in range(400)]
    rows = lm.score(spark.createDataFrame(made, "doc_id long, text string")).filter("held_out").collect()
    assert sum(r["score"] for r in rows) > 0.6 * sum(r["base_score"] for r in rows)
    assert all(r["score"] > r["base_score"] for r in rows)


def test_a_code_has_one_class_fine_and_coarse():
    vocabulary = lm.Vocabulary([("a", 5), ("b", 3)], 1, {lm._rest(b"a"): 5, lm._rest(b"b"): 3, lm._rest(b"zz"): 1}, {lm._rest(b"a"): 1, lm._rest(b"b"): 1, lm._rest(b"zz"): 1}, 2)
    codes, rare = vocabulary.encode("A b zz")
    assert list(codes) == [0, 1, -2 - lm._rest(b"zz"), -1] and dict(rare) == {b"zz": 1}
    assert list(vocabulary.classed(codes, 1)) == [1, 2 + lm._rest(b"b"), 2 + lm._rest(b"zz"), 0]
    assert vocabulary.class_tokens.sum() == vocabulary.n_tokens == 11


def test_topics_lead_by_count_and_ties_go_to_the_first():
    rng = np.random.default_rng(4)
    groups, coarse = rng.integers(0, lm.GROUPS, lm.COARSE), rng.integers(0, lm.COARSE, 500)
    bounds = np.array([0, 1, 1 + 37, 300, 500])
    got = lm.topics(coarse, bounds, groups)
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        for i in range(lo, hi):
            votes = np.bincount(groups[coarse[lo:i]], minlength=lm.GROUPS)
            assert got[i] == (votes.argmax() if i > lo else lm.GROUPS)


def test_counts_are_whole_when_a_tally_is_handed_on_early(monkeypatch):
    monkeypatch.setattr(lm, "TALLY", 3)
    parts = list(lm._counted(iter([pd.DataFrame({"text": ["a b c d", "a", None, "", "A b"]}), pd.DataFrame({"text": ["d"]})])))
    assert len(parts) == 2
    assert pd.concat(parts).groupby("h")["n"].sum().to_dict() == {lm._hash(w): n for w, n in ((b"a", 3), (b"b", 2), (b"c", 1), (b"d", 2))}
