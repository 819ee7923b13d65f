"""Secret scans against a plain Python version of the base rules."""

import hashlib
import random
import re

from ashlar.llm import secrets

_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text) if len(m[0]) >= 32]
    return sorted(out)


def texts():
    rng = random.Random(4)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    b64 = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n))
    plain = ["", None, "no secrets here", "tokén é token = \"" + hexes(40) + "\" end", "password=short", "token=secret: abcdefghij", "TOKEN: 'abcdefgh'"]
    plain += ["AKIA" + "Q" * 12 + " x AKIASHORT", hexes(31) + " " + hexes(32) + "g" + hexes(64), "𝒳 api_key=ABCDEFGH1234 𝒳 " + hexes(33), "x" * 200_000 + " secret=12345678"]
    plain += ["key " + b64(40) + " end" for _ in range(60)]
    plain += ["path SomeVeryLongIdentifierNameNumber2ForThingsLikeThis end"]
    return plain


def test_base_spans_match_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    got = {r["doc_id"]: r for r in secrets.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    names = secrets.KINDS
    for i, t in rows:
        want = base_spans(t)
        text = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in want)
        assert got[i]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest(), t
        assert [got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]] == [sum(k == j for _, k, _ in want) for j in range(3)]
        assert set(filter(None, text.split(","))) <= set(got[i]["spans"].split(","))


def test_random_tokens_are_added_and_structured_ones_are_not(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    got = secrets.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {r["doc_id"] for r in got if r["n_random"]}
    random_rows = {i for i, t in rows if t and t.startswith("key ")}
    assert len(found & random_rows) >= 0.8 * len(random_rows)
    assert len(found - random_rows) <= 0.05 * len(found)  # the controlled share


def test_redaction_masks_secrets_and_nothing_else(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    got = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        if t is None:
            assert got[i] is None
        elif not base_spans(t) and not t.startswith("key "):
            assert got[i] == t
        else:
            assert not base_spans(got[i])


def test_empty_table_and_repeated_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert secrets.digest(docs).count() == 0
    twice = spark.createDataFrame([(None, "password=12345678")] * 2, "doc_id long, text string")
    assert [r["n_assign"] for r in secrets.digest(twice).collect()] == [1, 1]


def test_cuts_have_no_step_at_any_number_of_tokens(spark):
    """One token more never moves a cut far; lone tokens have the plain test, many structured ones a high cut."""
    rng = random.Random(2)
    p = [rng.random() if rng.random() < 0.5 else rng.random() * 0.05 for _ in range(2 * secrets.SUPPORT + 20)]
    seen = []
    for n in (1, 2, *range(secrets.SUPPORT - 2, secrets.SUPPORT + 3), len(p)):
        rows = [(3, 5, x) for x in p[:n]] + [(3, 6, x) for x in p[:3]]
        seen.append({r["length_class"]: r["cut"] for r in secrets.cuts(spark.createDataFrame(rows, "kind int, length_class int, p double")).collect()})
    assert seen[0][5] == secrets.LEAST_P and seen[-1][5] > secrets.LEAST_P
    assert all(abs(a[k] - b[k]) <= 0.02 for a, b in zip(seen[2:-1], seen[3:-1], strict=False) for k in (5, 6))
    assert secrets.cuts(spark.createDataFrame([], "kind int, length_class int, p double")).count() == 0
