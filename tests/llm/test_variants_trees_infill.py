"""Spelling variants, document fingerprints and fill-in-middle against plain Python, and on edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from ashlar.llm import infill, merkle, spelling

# extra columns clash with names that the operators use inside
SCHEMA = "doc_id long, text string, n long, form string, word string, digest string, range long, extra string, cut string"
EDGE = ["", None, "one", " \n\t ", "é ñ 漢字 😀 naïve", "word " * 30_000, "same text here", "same text here", "tail space ", "a<P>b c", "x" * 5_000, "\n\n\nA.\n\nB!?\n"]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "f", "w", "d", 2, "e", "c") for i, t in rows], SCHEMA)


def near(a, b):
    """Whether exactly one edit parts two different words."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(rows):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    form, out = {}, {}
    for w, n in words.items():
        around = [x for x in words if near(w, x)]
        best = min(around, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
        out[w] = [n, len(around)]
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, *out[w], words[form[w]] if form[w] else None)
    return out


def as_rows(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.mark.parametrize("part", [1, 3, 4096])
def test_variants_equal_brute_force(spark, part):
    """With parts of one word each part is split down to one open code point."""
    rng = random.Random(part)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randint(5, 9))) for _ in range(12)] + ["prefixaaaa", "PREFIXaaab", "prefixaab", "xprefixaaaa"]
    rows = []
    for i in range(150):
        words = []
        for _ in range(20):
            w = rng.choice(base)
            if rng.random() < 0.4:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", "a", "b"]) + w[at + rng.randint(0, 1) :]
            words.append(w)
        rows.append((i if i % 11 else None, " ".join(words) + rng.choice([".", "1", ""])))
    rows += [(900 + i, t) for i, t in enumerate(EDGE)]
    rows += [(2000, "lantern " * 40 + "lanterns " * 18 + "lanternss " * 8 + "lanternsss " * 3)]
    want = plain_variants(rows)
    assert sum(v[0] is not None for v in want.values()) > 10 and want["lanternsss"][:2] == ("lanternss", "lantern")
    assert as_rows(spelling.variants(docs(spark, rows), part=part)) == want


def test_variants_ties_and_empty(spark):
    """Of two near words of one count the first in code-point order is the form."""
    rows = [(i, "zebras zebraz zebrax") for i in range(3)] + [(10 + i, "zebras zebraz") for i in range(5)]
    assert as_rows(spelling.variants(docs(spark, rows))) == plain_variants(rows)
    assert plain_variants(rows)["zebrax"][0] == "zebras"
    assert spelling.variants(docs(spark, [])).count() == 0


def test_trie_pairs_every_pair_once():
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(0, 7))) for _ in range(150)})
    got = [tuple(sorted((words[i], words[j]))) for i, j in spelling.trie_pairs(words)]
    assert len(got) == len(set(got))
    assert set(got) == {(a, b) for a in words for b in words if a < b and near(a, b)}


def plain_tree(text):
    """Sections of paragraphs of leaves, all with whole digests."""
    leaves = re.findall(merkle.PIECE, text)
    assert "".join(leaves) == text
    sections, paragraph = [[]], []
    for i, leaf in enumerate(leaves):
        paragraph.append(f"{hashlib.md5(leaf.encode()).hexdigest()}:{len(leaf)}")
        if leaf.endswith("\n") or i == len(leaves) - 1:
            done, paragraph = ",".join(paragraph), []
            sections[-1].append(done)
            if hashlib.md5(done.encode()).hexdigest()[0] < "4" or leaf == "\n" == leaves[i]:
                sections.append([])
    return [s for s in sections if s]


def spans_differ(a, b):
    """Longest common start and end of two texts."""
    head = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    tail = next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b), strict=False)) if x != y), min(len(a), len(b)))
    return head, len(a) - tail


def test_fingerprints_edges_and_edits(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    sentence = lambda: " ".join(word() for _ in range(rng.randint(3, 12))) + rng.choice([". ", "!\n", "? ", "\n"])
    rows = [(10 * i, "".join(sentence() for _ in range(rng.randint(1, 40)))) for i in range(60)]
    rows += [(1000 + i, t) for i, t in enumerate(EDGE)] + [(None, "no id"), (None, None), (0, rows[0][1]), (10, "another text under the id of the second")]
    out = merkle.fingerprints(docs(spark, rows))
    got = out.collect()
    assert len(got) == len(rows)
    key = lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5((r[1] or "").encode()).hexdigest())
    order = sorted(rows, key=key)
    want = Counter()
    for at, (i, text) in enumerate(order):
        text, following = text or "", order[(at + 1) % len(order)][1] or ""
        half = len(text) // 2
        want[(i, len(text), text[: len(text) - half] + following[:half])] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited"]) for r in got) == want
    by_id = {}
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (r["near_edited"] == 1.0) == (r["edit_start"] is None)
        by_id.setdefault(r["doc_id"], []).append(r)
    texts = {i: t or "" for i, t in rows if i is not None and i not in (0, 10)}
    roots = {}
    for i, text in texts.items():
        r = by_id[i][0]
        nodes = [hashlib.md5(";".join(s).encode()).hexdigest() for s in plain_tree(text)] or [hashlib.md5(b"").hexdigest()]
        assert r["fingerprint"].split("|")[0] == hashlib.sha256("".join(nodes).encode()).hexdigest()
        assert roots.setdefault(r["fingerprint"], text) == text  # different texts, different fingerprints
        if r["edit_start"] is not None:
            start, end = spans_differ(text, r["edited"])
            assert 0 <= r["edit_start"] <= start and end <= r["edit_end"] <= len(text)
    assert by_id[1006][0]["fingerprint"] == by_id[1007][0]["fingerprint"] and by_id[1007][0]["near_next"] == 1.0
    prose = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 600 and r["n_chars"] > 800 and r["doc_id"] not in (0, 10)]
    assert len(prose) > 20 and all(r["near_edited"] > 0.3 > r["near_next"] for r in prose)


def test_fingerprint_of_a_local_edit_keeps_the_other_branches(spark):
    lines = [f"Line {i} has its own words, number {i * i}.\n" for i in range(400)]
    other = lines[:200] + ["An inserted line.\n"] + lines[200:]
    df = spark.createDataFrame([("".join(lines), "".join(other))], "a string, b string")
    a, b = merkle.fingerprint(df.a), merkle.fingerprint(df.b)
    r = df.select(merkle.likeness(a, b).alias("near"), merkle.edit_span(a, b).alias("span"), merkle.likeness(a, a).alias("same")).first()
    assert 0.99 < r["near"] < 1.0 and r["same"] == 1.0
    assert r["span"]["start"] == r["span"]["end"] == len("".join(lines[:200]))


@pytest.mark.parametrize("n", [0, 1, 2, 700])
def test_next_text_over_ranges(spark, n):
    """Ids with gaps and hot ids, over several ranges: the same as one sorted list."""
    rng = random.Random(n)
    rows = [(rng.choice([7, None, rng.randrange(-50, 50), rng.randrange(10**12)]), f"t{rng.randrange(10**6)}") for _ in range(n)]
    got = Counter((r["doc_id"], r["text"], r["next_text"]) for r in merkle.with_next(docs(spark, rows)).collect())
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5(r[1].encode()).hexdigest()))
    assert got == Counter((*r, order[(i + 1) % n][1]) for i, r in enumerate(order))


UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_infill(i, text):
    text = text or ""
    unit = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(unit)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    p, m, s = "".join(unit[:low]), "".join(unit[low:high]), "".join(unit[high:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_infill_equals_plain_units_and_restores(spark):
    rng = random.Random(9)
    alphabet = ["a", "é", "😀", "<", "S", ">", "<S", "P>", " ", "\n", "\t", "\x0b", "\x0c", "\r", "\xa0", " ", "\x1c", "\x85"]
    rows = [(i if i % 7 else None, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))) for i in range(600)]
    rows += [(k * 1000 + i, t) for k in range(1, 8) for i, t in enumerate(EDGE)]
    made = infill.fill_in_middle(docs(spark, rows))
    back = infill.restore(made.output, made.form).alias("back")
    got = Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in made.select("*", back).collect())
    want = Counter((i, *plain_infill(i, t), t or "") for i, t in rows)
    assert got == want
    assert {k[2] for k in want} == {"plain", "spm", "psm"}
    assert infill.fill_in_middle(docs(spark, [])).count() == 0
