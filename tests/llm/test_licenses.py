"""Licence scans against a plain reading, sentence by sentence, of texts made of the catalogue's sentences."""

import random
import re

import pytest

from ashlar.llm import licenses


def plain_normalise(s):
    return re.sub(" +", " ", re.sub(r"[^a-z0-9.]+|\.(?![0-9])|(?<![0-9v])\.", " ", s.lower())).strip()


def plain_identify(s):
    for name, start in licenses.SENTENCES:
        if re.search(".*".join(re.escape(p) for p in start.split("*")), s):
            return name
    tag = re.search(rf"{licenses._TAG}([a-z0-9. ]+)$", s)
    for name, _ in reversed(licenses.NAMES):
        if tag and tag[1] == name.lower().replace("-", " "):
            return f"tag={name}"
    for name, pattern in licenses.NAMES:
        if re.search(rf"{licenses._GRANT}(?:{pattern})(?: |$)", s):
            return f"grant={name}"
    return None


def plain_scan(text):
    """All sentences are read, whether or not one of the triggers is in them."""
    known = [(i, plain_identify(plain_normalise(s))) for i, s in enumerate(re.split(licenses.BOUNDARY, text or ""))]
    known = [(i, k) for i, k in known if k]
    runs = []
    for n, (i, k) in enumerate(known):
        if n and i - known[n - 1][0] > licenses.MAX_GAP + 1:
            runs.append("")
        runs.append(k)
    found = []
    for name, ids in licenses.RULES:
        at, hit = 0, False
        while at + len(ids) <= len(runs):
            if tuple(runs[at : at + len(ids)]) == ids:
                runs[at : at + len(ids)] = ["-"]
                hit = True
            at += 1
        if hit:
            found.append(name)
    found += [r.split("=")[1] for r in runs if "=" in r]
    return len(known), ",".join(k for _, k in known), ",".join(sorted(set(found)))


PROSE = ["The river rose in the night.", "Nobody knew why; all waited.", "It was released under a cloud.", "He read the terms of v2.0 aloud.", "A copy lay on the table!", "\n\n", "Copyright 2020 A. B."]


@pytest.mark.parametrize("seed", [1, 2])
def test_scan_equals_plain_reading(spark, seed):
    rng = random.Random(seed)
    texts = {name: start.replace("*", "the holder, version 2.1 or so,") for name, start in licenses.SENTENCES}
    grants = ["Released under the MIT License", "licensed under Apache License, Version 2.0", "Distributed under GPLv3", "SPDX-License-Identifier: BSD-3-Clause", "published under Creative Commons Attribution 4.0", "SPDX-License-Identifier: CC-BY-SA-3.0"]
    rows = ["", None, " \n "]
    for _ in range(150):
        parts = []
        while rng.random() < 0.85:
            kind = rng.random()
            if kind < 0.3:
                ids = rng.choice(licenses.RULES)[1]
                parts += [texts.get(i, "Licensed under the Apache License, Version 2.0") + "." for i in ids]
            elif kind < 0.5:
                s = rng.choice(list(texts.values()))
                parts.append(rng.choice([s, s.upper(), s.capitalize(), s.replace(" ", "  "), s.replace(" ", ", ", 1)]) + rng.choice([".", ";", ""]))
            elif kind < 0.65:
                parts.append(rng.choice(grants) + rng.choice([".", "\n"]))
            else:
                parts.append(rng.choice(PROSE))
        rows.append(rng.choice([" ", "\n", "\n# "]).join(parts))
    rows.append("word. " * 20_000 + texts["mit-grant"] + ". " + texts["mit-notice"] + ".")
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate([*rows, *rows[:5]])], "doc_id long, text string, licenses string, known int")
    got = {}
    for r in licenses.scan(df).collect():
        got[r["doc_id"]] = (r["n_known"], r["sentences"], r["licenses"])
    want = {i: plain_scan(t) for i, t in enumerate([*rows, *rows[:5]])}
    assert got == want
    assert len({n for _, _, names in want.values() for n in names.split(",")}) > 8
    assert licenses.scan(df.limit(0)).count() == 0
